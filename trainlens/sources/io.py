"""Dataset scans and result sinks.

Every layout is read by many tasks: JSON Lines and CSV without line breaks
inside fields by the built-in sources, JSON arrays, ``{"data": [...]}`` documents
and CSV with such fields (``multi_line``) by byte ranges (``structural.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlens.functions.text import strip
from trainlens.plans.ordinal import with_ordinal
from trainlens.sources.structural import csv_records, json_elements

_PLACE = ["_path", "_block"]


def _file_ordinal(scan: DataFrame, columns: list) -> DataFrame:
    """``columns`` of a file scan and ``ordinal``, the row's index in order of
    (file path, place in the file).

    A split's rows are numbered as they are read; the splits' row counts (one
    row per split) give each split's offset. Rows are not shuffled.
    """
    d = scan.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"),
                    F.monotonically_increasing_id().alias("_mono"))
    splits = d.groupBy(*_PLACE).agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)
    start = splits.select(*_PLACE, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return d.join(start, _PLACE).withColumn("ordinal", F.col("_mono") + F.col("_shift")).drop(*_PLACE, "_mono", "_shift")


def _as_text(c: str):
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)


def read_csv_dataset(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """S01 + S05: CSV with a header, every field a string (null -> ''), plus
    ``ordinal``, the row's index in order of (file path, place in the file).
    ``multi_line=False`` promises that no field has a line break."""
    if not multi_line:
        raw = spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path)
        return _file_ordinal(raw, [_as_text(c) for c in raw.columns])
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    shape = T.StructType([T.StructField(c, T.StringType()) for c in names])
    rec = csv_records(spark, path)
    head = rec.groupBy("path").agg(F.min("ordinal").alias("head"))  # a file's first record is its header
    rows = rec.join(F.broadcast(head), "path").where("ordinal > head").select("path", F.col("ordinal").alias("_at"), F.from_csv(
        "text", shape.toDDL(), {"escape": '"', "multiLine": "true"}).alias("_row"))
    rows = rows.select(*[F.coalesce(F.col(f"_row.`{c}`"), F.lit("")).alias(c) for c in names], F.col("path").alias("_path"), "_at")
    return _numbered(rows)


def _numbered(rows: DataFrame) -> DataFrame:
    """``ordinal`` in order of (_path, _at)."""
    keys = with_ordinal(rows.select("_path", "_at"), ["_path", "_at"], "ordinal")
    return rows.join(keys, ["_path", "_at"]).drop("_path", "_at")


def read_jsonl_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S02 at scale: JSON Lines. Returns (records, violations): every field read
    as a string, plus ``ordinal``; lines that are no JSON object come back as
    (ordinal, reason) instead."""
    shape = spark.read.option("primitivesAsString", True).json(path).schema
    names = [c for c in shape.names if c != "_corrupt_record"]
    line = F.col("value")
    parsed = F.from_json(line, T.StructType([shape[c] for c in names]))
    good = F.json_object_keys(line).isNotNull()
    scan = spark.read.text(path).where(F.length(strip(line)) > 0)
    rows = _file_ordinal(scan, [parsed.alias("_row"), good.alias("_good")])
    recs = rows.where("_good").select(*[F.coalesce(F.col(f"_row.`{c}`").cast("string"), F.lit("")).alias(c) for c in names], "ordinal")
    return recs, rows.where("NOT _good").select("ordinal", F.concat(
        F.lit("Invalid dataset row at index "), F.col("ordinal").cast("string"), F.lit(": row must be a JSON object")).alias("reason"))


def read_json_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S02 + S03: JSON arrays, or an object whose ``data`` member is an array.

    Returns (records, violations). records: (ordinal, record MAP<STRING,
    STRING>) with values as JSON text (strings unquoted, null -> '');
    violations: (ordinal, reason) for elements that are not objects, and one
    row with ordinal -1 for a document that is no closed list of records (the
    elements that can be read are returned all the same).
    """
    ex, files = json_elements(spark, path)
    bad_root = files.where("NOT complete").select(
        F.lit(-1).cast("long").alias("ordinal"),
        F.lit("JSON dataset must be a list or an object with a 'data' list").alias("reason"))
    is_obj = F.json_object_keys("elem").isNotNull()
    viol = ex.where(~is_obj).select(
        "ordinal", F.concat(F.lit("Invalid dataset row at index "), F.col("ordinal").cast("string"),
                            F.lit(": row must be a JSON object")).alias("reason"))
    recs = ex.where(is_obj).select(
        "ordinal", F.transform_values(F.from_json("elem", "map<string,string>"),
                                      lambda k, v: F.coalesce(v, F.lit(""))).alias("record"))
    return recs, bad_root.unionByName(viol)


def record_columns(records: DataFrame, fields: list[str]) -> DataFrame:
    """Project map records to string columns (absent -> null)."""
    return records.select("ordinal", *[F.col("record").getItem(f).alias(f) for f in fields])


def read_manifest(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(sample_id, split, pos) rows and (line, reason) violations.

    The ``sample_id`` column is required; a blank id is reported with its CSV
    line number (header is line 1). A missing optional test manifest is empty;
    any other manifest must exist and have rows.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if not fs.exists(jpath):
        if split == "test":
            empty = spark.createDataFrame([], "sample_id string, split string, pos long")
            return empty, spark.createDataFrame([], "line long, reason string")
        raise FileNotFoundError(f"Required split manifest not found: {path}")
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if "sample_id" not in raw.columns:
        raise ValueError(f"Split manifest '{path}' must include a 'sample_id' column. "
                         f"Found columns: {raw.columns}")
    m = _file_ordinal(raw, [strip("sample_id").alias("sample_id")])
    if split != "test" and m.limit(1).count() == 0:
        raise ValueError(f"Split manifest '{path}' has no rows")
    viol = m.where(F.coalesce(F.length("sample_id"), F.lit(0)) == 0).select(
        (F.col("ordinal") + 2).alias("line"),
        F.lit(f"Split manifest '{path}' has an empty sample_id").alias("reason"))
    ok = m.where(F.length("sample_id") > 0).select("sample_id", F.lit(split).alias("split"),
                                                   F.col("ordinal").alias("pos"))
    return ok, viol


def write_manifests(splits: DataFrame, out_dir: str) -> None:
    """One CSV folder per split with the fixed columns (absent -> '')."""
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in splits.columns else F.lit("").alias(c)
            for c in ("sample_id", "source", "license")]
    (splits.select(*cols, "split").write.mode("overwrite").option("header", True)
           .partitionBy("split").csv(out_dir))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Normalized records snapshot as JSON Lines."""
    df.write.mode("overwrite").json(path)


def write_attribution(results: DataFrame, out_dir: str) -> DataFrame:
    """Result rows as Parquet, CSV and JSON records; returns the
    one-row-per-method summary. The results are computed once; the other forms
    are written from the Parquet copy."""
    results.write.mode("overwrite").parquet(f"{out_dir}/parquet")
    rows = results.sparkSession.read.parquet(f"{out_dir}/parquet")
    rows.write.mode("overwrite").option("header", True).csv(f"{out_dir}/csv")
    rows.write.mode("overwrite").json(f"{out_dir}/json")
    summary = (rows.groupBy("method")
               .agg(F.countDistinct("test_idx").alias("n_probes"), F.count(F.lit(1)).alias("n_rows"),
                    F.max("rank").alias("top_k")))
    summary.coalesce(1).write.mode("overwrite").json(f"{out_dir}/summary")
    return summary


def read_run_artifacts(spark: SparkSession, pattern: str) -> DataFrame:
    """One JSON object per file (e.g. ``runs/*/train/metrics.json``) with
    the run id taken from the path (the folder under the root)."""
    df = spark.read.option("multiLine", True).json(pattern)
    return df.withColumn("_path", F.col("_metadata.file_path")) \
             .withColumn("run_id", F.regexp_extract("_path", r"/([^/]+)/(?:train/)?[^/]+\.json$", 1)) \
             .drop("_path")


def write_influence(matrix: DataFrame, topk: DataFrame, out_dir: str) -> None:
    """The influence matrix as CSV (test_id, train_id, influence_score, rank)
    and the per-probe top-k lists as JSON."""
    (matrix.select("test_id", "train_id", "influence_score", "rank")
           .write.mode("overwrite").option("header", True).csv(f"{out_dir}/influence_matrix"))
    topk.write.mode("overwrite").json(f"{out_dir}/topk")
