"""Training-run tables derived from the ``events`` log.

Each user's event stream stands for one training run: events are steps in
(ts, event_id) order and ``value`` is the logged loss. Everything is a
per-run aggregation (shuffle on run_id only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.sources.tables import read_table

STEPS_PER_EPOCH = 50


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, ts, event_id, loss)."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("loss"))


def run_metrics(spark: SparkSession, sf_dir: str, per_day: bool = False) -> DataFrame:
    """One row per run with the runtime metric keys of a metrics file; a run is
    a user, or with ``per_day`` a user's day (run_id ``user-date``)."""
    e = read_table(spark, sf_dir, "events")
    key = F.struct("ts", "event_id")
    # ts is a wall-clock (NTZ) timestamp; read it in UTC to take differences
    runtime = (F.unix_micros(F.max("ts").cast("timestamp"))
               - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    run = F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")) if per_day else F.col("user_id")
    g = e.groupBy(run.alias("run_id")).agg(
        F.count(F.lit(1)).alias("steps"), runtime.alias("train_runtime"),
        F.max_by("value", key).alias("train_loss"), F.sum("value").alias("tokens"))
    rate = F.when(F.col("train_runtime") > 0, F.col("steps") / F.col("train_runtime"))
    tok_rate = F.when(F.col("train_runtime") > 0, F.col("tokens") / F.col("train_runtime"))
    return (g.withColumn("epochs_completed", F.col("steps") / F.lit(float(STEPS_PER_EPOCH)))
             .withColumn("train_steps_per_second", rate)
             .withColumn("train_tokens_per_second", tok_rate)
             .withColumn("timing_breakdown_s", F.create_map(F.lit("train"), F.col("train_runtime")))
             .withColumn("throughput", F.struct(rate.alias("steps_per_second"),
                                                tok_rate.alias("tokens_per_second"))))
