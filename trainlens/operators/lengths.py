"""Sequence-length and throughput statistics.

T01, T02 and T07 run over token rows; T03-T06 are column expressions over a
table of runs, so every run is resolved in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_length(tok: DataFrame) -> DataFrame:
    """Sum of the attention mask when present, else the number of ids."""
    mask_sum = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x)
    return tok.withColumn("seq_len", F.coalesce(mask_sum, F.size("input_ids").cast("long")))


def padding_footprint(lengths: DataFrame, batch_size: int, cap: int, pos_col: str = "pos") -> DataFrame:
    """Contiguous batches of ``batch_size`` rows by position; returns
    (padded_tokens, max_length_tokens, ratio) where padded = sum over batches
    of min(max length, cap) * rows and the baseline pads every row to cap."""
    b = (lengths.groupBy(F.floor(F.col(pos_col) / batch_size).alias("batch"))
                .agg(F.max("seq_len").alias("mx"), F.count(F.lit(1)).alias("rows"),
                     F.sum("seq_len").alias("tokens")))
    return b.agg(F.sum(F.least(F.col("mx"), F.lit(cap)) * F.col("rows")).alias("padded_tokens"),
                 (F.sum("rows") * cap).alias("max_length_tokens"),
                 F.sum("tokens").alias("n_tokens")) \
            .withColumn("ratio", F.col("padded_tokens") / F.col("max_length_tokens"))


def baseline_rate(observed, ratio):
    """Estimated max-length baseline rate = observed x padding ratio (0 when unknown)."""
    return F.when((observed > 0) & (ratio > 0), observed * ratio).otherwise(F.lit(0.0))


def speedup_pct(observed, baseline):
    """Speed-up of the observed rate over the baseline, guarded against 0."""
    return F.when(baseline > 0, (observed - baseline) / baseline * 100.0).otherwise(F.lit(0.0))


def token_rate_estimate(avg_len, batch, accum, steps, runtime):
    """Avg length x batch x accumulation x steps / runtime; 0 on bad input."""
    ok = (avg_len > 0) & (batch > 0) & (accum > 0) & (steps > 0) & (runtime > 0)
    return F.when(ok, avg_len * batch * accum * steps / runtime).otherwise(F.lit(0.0))


def resolve_token_rate(measured, reported, estimated):
    """Measured > reported > estimated, each used only when positive."""
    pos = [F.when(F.col(c).try_cast("double") > 0, F.col(c).try_cast("double"))
           if isinstance(c, str) else F.when(c > 0, c) for c in (measured, reported, estimated)]
    return F.coalesce(*pos, F.lit(0.0))


def resolve_steps(state_step, metric_step, runtime, rate):
    """(steps, estimated flag): trainer state, else the metric, else
    round-half-even(runtime x rate), else 0."""
    est = F.bround(runtime * rate, 0).cast("long")
    steps = F.coalesce(F.when(state_step > 0, state_step.cast("long")),
                       F.when(metric_step > 0, metric_step.cast("long")),
                       F.when((runtime > 0) & (rate > 0), est), F.lit(0))
    flag = (state_step.isNull() | (state_step <= 0)) & (metric_step.isNull() | (metric_step <= 0))
    return steps, flag


def count_tokens(tok: DataFrame) -> DataFrame:
    """Non-pad tokens over all rows (sum of the attention masks)."""
    return effective_length(tok).agg(F.sum("seq_len").alias("n_tokens"))
