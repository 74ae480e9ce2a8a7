"""Run-quality gates over a table of runs.

The checks that the reference applies to one run directory are applied here
to every run at once: each run is a row, each check a column, and the gate
report is the unpivoted table.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlens.functions.files import read_range

# Required keys of the run artifacts.
REQUIRED_PARAMS_KEYS = ("run_id", "output_dir", "base_model_path", "tokenizer_name_or_path",
                        "dataset_json_path")
REQUIRED_METRICS_KEYS = ("train_runtime", "train_loss", "steps", "train_steps_per_second", "throughput")
REQUIRED_RUNTIME_METRIC_KEYS = ("train_runtime", "train_loss", "steps", "epochs_completed",
                                "train_steps_per_second", "train_tokens_per_second",
                                "timing_breakdown_s", "throughput")
REQUIRED_THROUGHPUT_KEYS = ("steps_per_second", "tokens_per_second")
REQUIRED_PAIR_METRICS = ("train_loss", "steps", "train_steps_per_second", "epochs_completed")


# Default gate thresholds and reproducibility tolerances.
@dataclass(frozen=True)
class GateThresholds:
    min_steps: int = 100
    min_epochs: float = 1.0
    max_final_loss: float = 3.0


@dataclass(frozen=True)
class ReproTolerance:
    loss: float = 1e-4
    rate: float = 0.5


def json_key_audit(docs: DataFrame, json_col: str, required: tuple[str, ...], label: str) -> DataFrame:
    """(run_id, file, missing_key) for every required key a JSON object lacks.

    docs: (run_id, <json_col> STRING). A document that is not an object lacks
    every key.
    """
    keys = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    req = F.array(*[F.lit(k) for k in required])
    missing = F.array_except(req, keys)
    return (docs.select("run_id", F.lit(label).alias("file"), F.explode(missing).alias("missing_key")))


def state_audit(states: DataFrame, json_col: str = "trainer_state") -> DataFrame:
    """Trainer states with neither ``global_step`` nor ``log_history``."""
    keys = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    bad = ~F.array_contains(keys, "global_step") & ~F.array_contains(keys, "log_history")
    return states.where(bad).select("run_id", F.lit("trainer_state.json").alias("file"),
                                    F.lit("global_step|log_history").alias("missing_key"))


def struct_key_audit(runs: DataFrame, required: tuple[str, ...], nested: str | None = None,
                     nested_required: tuple[str, ...] = ()) -> DataFrame:
    """(run_id, missing_key) for null or absent metric fields of a runs table."""
    checks = [F.when(F.col(k).isNull(), F.lit(k)) if k in runs.columns else F.lit(k) for k in required]
    if nested and nested in runs.columns:
        checks += [F.when(F.col(f"{nested}.{k}").isNull(), F.lit(f"{nested}.{k}")) for k in nested_required]
    arr = F.filter(F.array(*checks), lambda x: x.isNotNull())
    return runs.select("run_id", F.explode(arr).alias("missing_key"))


def loss_endpoints(log: DataFrame, order: list[str]) -> DataFrame:
    """G03 helper: per run, first and last finite loss in ``order`` and their count.

    log: (run_id, loss, <order cols>); NaN, +-inf and null losses are dropped.
    """
    finite = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs(F.col("loss")) != float("inf"))
    key = F.struct(*[F.col(c) for c in order])
    return (log.where(finite).groupBy("run_id")
               .agg(F.min_by("loss", key).alias("first_loss"), F.max_by("loss", key).alias("last_loss"),
                    F.count(F.lit(1)).alias("n_loss")))


def gate_checks(runs: DataFrame, losses: DataFrame, t: GateThresholds = GateThresholds()) -> DataFrame:
    """G02 + G03 + G04 as boolean columns per run.

    runs: (run_id, steps, epochs_completed, train_loss, and the runtime
    metric keys); losses: output of :func:`loss_endpoints`.
    """
    fin = F.col("train_loss").isNotNull() & ~F.isnan("train_loss") & \
        (F.abs(F.col("train_loss")) != float("inf"))
    missing = struct_key_audit(runs, REQUIRED_RUNTIME_METRIC_KEYS, "throughput", REQUIRED_THROUGHPUT_KEYS) \
        .groupBy("run_id").agg(F.count(F.lit(1)).alias("n_missing"))
    return (runs.join(losses, "run_id", "left").join(missing, "run_id", "left")
                .select("run_id",
                        (F.coalesce(F.col("steps"), F.lit(0)) >= t.min_steps).alias("min_steps"),
                        (F.coalesce(F.col("epochs_completed"), F.lit(0.0)) >= t.min_epochs).alias("min_epochs"),
                        (fin & (F.col("train_loss") <= t.max_final_loss)).alias("final_loss"),
                        F.coalesce(F.col("last_loss") <= F.col("first_loss"), F.lit(True)).alias("loss_trend"),
                        (F.coalesce(F.col("n_missing"), F.lit(0)) == 0).alias("runtime_metrics")))


CHECKS = ("min_steps", "min_epochs", "final_loss", "loss_trend", "runtime_metrics")


def gate_report(checks: DataFrame) -> DataFrame:
    """One row per (run, check) plus the run's overall verdict (all checks)."""
    long = checks.select("run_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in CHECKS])).alias("c")) \
        .select("run_id", "c.check", "c.passed")
    overall = checks.select("run_id", F.lit("overall").alias("check"),
                            F.expr(" AND ".join(CHECKS)).alias("passed"))
    return long.unionByName(overall)


def pair_reproducibility(runs: DataFrame, pair_col: str, order_col: str, tol: ReproTolerance = ReproTolerance(), *,
                         params_col: str | None = None, required: tuple[str, ...] = REQUIRED_PAIR_METRICS) -> DataFrame:
    """Compare the two runs of each pair: equal parameter keys, all required
    metrics there, equal steps, loss and rate drift.

    runs: (pair_col, order_col, steps, train_loss, train_steps_per_second, the
    other required metrics, and optionally ``params_col``, an array of each
    run's parameter keys, whose order doesn't matter). Pairs are formed by
    ``pair_col`` (a groupBy, not a global lag window).

    ``status`` is ``unpaired`` / ``ambiguous`` where a key has one run or more
    than two, which have null drifts and a null verdict; else
    ``parameter_keys`` where the runs' key sets differ (``keys_differ`` lists
    the keys of one only), ``metric_missing`` where a required metric is null or
    no column (``metrics_missing`` lists them), and ``paired``. Only paired runs
    can be reproducible.
    """
    key = F.col(order_col)
    keys = F.array_sort(F.array_distinct(F.coalesce(F.col(params_col), F.array().cast("array<string>")))) if params_col else F.array().cast("array<string>")
    absent = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) if m in runs.columns else F.lit(m) for m in required]))
    g = runs.withColumn("_keys", keys).withColumn("_absent", absent).groupBy(pair_col).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.min_by("steps", key).alias("steps_a"), F.max_by("steps", key).alias("steps_b"),
        F.min_by("train_loss", key).alias("loss_a"), F.max_by("train_loss", key).alias("loss_b"),
        F.min_by("train_steps_per_second", key).alias("rate_a"),
        F.max_by("train_steps_per_second", key).alias("rate_b"),
        F.min_by("_keys", key).alias("_keys_a"), F.max_by("_keys", key).alias("_keys_b"),
        F.array_sort(F.array_union(F.min_by("_absent", key), F.max_by("_absent", key))).alias("_absent"))
    pair = F.col("n_runs") == 2
    differ = F.array_sort(F.array_union(F.array_except("_keys_a", "_keys_b"), F.array_except("_keys_b", "_keys_a")))
    status = (F.when(F.col("n_runs") < 2, "unpaired").when(F.col("n_runs") > 2, "ambiguous").when(F.size("keys_differ") > 0, "parameter_keys")
              .when(F.size("metrics_missing") > 0, "metric_missing").otherwise("paired"))
    same = ((F.col("steps_a") == F.col("steps_b")) & (F.col("loss_drift") <= tol.loss) & (F.col("rate_drift") <= tol.rate))
    return (g.withColumn("keys_differ", F.when(pair, differ)).withColumn("metrics_missing", F.when(pair, F.col("_absent")))
             .withColumn("status", status)
             .withColumn("loss_drift", F.when(pair, F.abs(F.col("loss_a") - F.col("loss_b"))))
             .withColumn("rate_drift", F.when(pair, F.abs(F.col("rate_a") - F.col("rate_b"))))
             .withColumn("reproducible", F.when(pair, F.coalesce((F.col("status") == "paired") & same, F.lit(False))))
             .drop("_keys_a", "_keys_b", "_absent"))


LEAF_BYTES = 8 << 20
FAN = 1024  # digests under one node of the tree


def artifact_leaves(spark, root: str, glob: str = "*", *, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(run, relpath, leaf, offset, length, sha256) of every byte range of
    every artifact file under ``root``/<run>/. The driver lists files only; the
    ranges, rows like any other, are read by as many tasks as there is work for."""
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    # the scan skips empty files, the listing has them
    listed = spark.createDataFrame([(re.sub(r"^file:/+", "file:/", unquote(p)),) for p in scan.inputFiles()], "path string")
    files = listed.join(scan.select("path", "length"), "path", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    rel = F.regexp_replace(F.col("path"), r"^.*?/" + root.rstrip("/").split("/")[-1] + "/", "")
    last = F.greatest(F.lit(0), F.floor((F.col("length") - 1) / leaf_bytes)).cast("long")
    ranges = (files.select("path", F.split(rel, "/").getItem(0).alias("run"), F.regexp_replace(rel, r"^[^/]+/", "").alias("relpath"), "length",
                           F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("leaf"))
              .withColumn("offset", F.col("leaf") * leaf_bytes).withColumn("length", F.least(F.lit(leaf_bytes).cast("long"), F.col("length") - F.col("offset"))))

    def digest(batches):
        for b in batches:
            path, offset, length = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "offset", "length"))
            sha = [hashlib.sha256(read_range(p, o, n)).hexdigest() for p, o, n in zip(path, offset, length, strict=True)]
            keep = [b.column(b.schema.get_field_index(c)) for c in ("run", "relpath", "leaf", "offset", "length")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sha, pa.string())], ["run", "relpath", "leaf", "offset", "length", "sha256"])
    dealt = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "leaf")
    return dealt.mapInArrow(digest, "run string, relpath string, leaf long, offset long, length long, sha256 string")


def tree_hashes(leaves: DataFrame) -> DataFrame:
    """(run, relpath, leaves, bytes, sha256): per file the root of a tree whose
    nodes are the sha256 of up to ``FAN`` digests below them, in order. A file of
    one leaf has its usual sha256. A level has ``FAN`` times fewer rows than the
    one below, so no group grows with the file."""
    key = ["run", "relpath"]
    level = leaves.select(*key, F.col("leaf").alias("i"), "sha256", F.lit(1).cast("long").alias("leaves"), F.col("length").alias("bytes")).checkpoint()
    while (level.agg(F.max("i")).first()[0] or 0) > 0:
        below = level.select(*key, F.floor(F.col("i") / FAN).cast("long").alias("i"), F.struct("i", "sha256").alias("d"), "leaves", "bytes")
        node = below.groupBy(*key, "i").agg(F.sort_array(F.collect_list("d")).alias("d"), F.sum("leaves").alias("leaves"), F.sum("bytes").alias("bytes"))
        digests = F.transform("d", lambda x: x["sha256"])
        level = node.select(*key, "i", F.when(F.size("d") == 1, digests[0]).otherwise(F.sha2(F.array_join(digests, ""), 256)).alias("sha256"), "leaves", "bytes").checkpoint()
    return level.drop("i")


def artifact_hashes(spark, root: str, glob: str = "*", *, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """(run, relpath, leaves, bytes, sha256) of every artifact file, of any
    size. Compare two runs by joining on the relative path."""
    return tree_hashes(artifact_leaves(spark, root, glob, leaf_bytes=leaf_bytes))


def compare_artifacts(hashes: DataFrame, run_a: str, run_b: str, leaves: DataFrame | None = None) -> DataFrame:
    """Per relative path, whether the two runs hold identical bytes; with
    ``leaves`` also the offset and length of the first byte range that differs
    (of the longer file where one ends first; null where a file is missing)."""
    side = lambda df, run, name: df.where(F.col("run") == run).select("relpath", F.col("sha256").alias(name))
    out = (side(hashes, run_a, "a").join(side(hashes, run_b, "b"), "relpath", "full")
           .withColumn("match", F.coalesce(F.col("a") == F.col("b"), F.lit(False))))
    if leaves is None:
        return out
    cols = lambda run: leaves.where(F.col("run") == run).select("relpath", "leaf", "offset", "length", "sha256")
    x, y = cols(run_a).alias("x"), cols(run_b).alias("y")
    differ = x.join(y, (F.col("x.relpath") == F.col("y.relpath")) & (F.col("x.leaf") == F.col("y.leaf")), "full").where(
        ~F.col("x.sha256").eqNullSafe(F.col("y.sha256")))
    first = differ.select(F.coalesce("x.relpath", "y.relpath").alias("relpath"), F.coalesce("x.leaf", "y.leaf").alias("leaf"),
                          F.coalesce("x.offset", "y.offset").alias("offset"), F.greatest("x.length", "y.length").alias("length"))
    first = first.groupBy("relpath").agg(F.min(F.struct("leaf", "offset", "length")).alias("d"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return (out.join(first, "relpath", "left")
            .withColumn("first_offset", F.when(both, F.col("d.offset"))).withColumn("first_length", F.when(both, F.col("d.length"))).drop("d"))
