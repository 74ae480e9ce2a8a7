"""Distributed running sums and row ordinals.

A window with no PARTITION BY moves the whole table into one task. Instead:
range-partition on the sort key, total each partition (one row per partition),
turn the totals into offsets (a window over those rows), then add up each
sorted partition where it lies, in Arrow batches, on top of its offset. The
broadcast side has one row per partition; rows are shuffled once.

Callers hand in the key and value columns only: the rows are written once to
the checkpoint folder, so payloads (texts, vectors) are joined back by key
where they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _wide(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()


def _running(values: list[str]):
    """The sum of every value column before each row of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(values, 0)
        for b in batches:
            cols = list(b.columns)
            for v in values:
                x = b.column(b.schema.get_field_index(v))
                x = x.cast(pa.int64() if pa.types.is_integer(x.type) else pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
                upto = np.cumsum(x)
                cols.append(pa.array(so_far[v] + upto - x))
                so_far[v] += upto[-1] if len(x) else 0
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *[f"_ex_{v}" for v in values]])
    return run


def prefix_sums(df: DataFrame, order: list, values: list[str], *, prefix: str = "cum_",
                n_partitions: int | None = None, inclusive: bool = True,
                partition_by: list[str] | None = None) -> DataFrame:
    """Add ``{prefix}{v}``: running sum of each value column in ``order``.

    ``order`` must be a total order (add a unique tie-breaker) for the result
    to be deterministic; values must not be negative. ``inclusive`` counts the
    current row. With ``partition_by`` the sums restart in every group (nulls
    are a group): the running sum over (group, order) minus its value before
    the group's first row.
    """
    keys = list(partition_by or [])
    n = n_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    # Range bounds come from sampling the input, and row order inside shuffled
    # partitions is not stable between evaluations, so the partitioned rows
    # are checkpointed once (shared checkpoint folder): the totals and the
    # per-row sums then read the same partitions, also after executor loss.
    r = (df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id())
           .checkpoint(eager=True))
    # totals per partition and group: at most one row more for each group than
    # there are partitions
    some = r.groupBy("_pid", *keys).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = some.groupBy("_pid").agg(*[F.sum(v).alias(v) for v in values]) if keys else some
    offsets = totals.select("_pid", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_off_{v}")
                                      for v in values])
    # the partitions are those of the checkpoint, so sorting them is enough
    sums = r.sortWithinPartitions(*order_cols)
    sums = sums.mapInArrow(_running(values), T.StructType([*r.schema.fields, *[
        T.StructField(f"_ex_{v}", _wide(r.schema[v].dataType)) for v in values]]))
    out = sums.join(F.broadcast(offsets), "_pid")
    for v in values:
        out = out.withColumn(f"_ex_{v}", F.col(f"_off_{v}") + F.col(f"_ex_{v}"))
    if keys:
        # a group starts where its first partition has come to before it
        inner = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
        start = some.join(F.broadcast(offsets), "_pid").select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[
            (F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(inner), F.lit(0))).alias(f"_gs_{v}") for v in values])
        start = start.groupBy(*[f"_g_{k}" for k in keys]).agg(*[F.min(f"_gs_{v}").alias(f"_gs_{v}") for v in values])
        same = [out[k].eqNullSafe(start[f"_g_{k}"]) for k in keys]
        out = out.join(start, same).drop(*[f"_g_{k}" for k in keys])
    for v in values:
        total = F.col(f"_ex_{v}") - (F.col(f"_gs_{v}") if keys else F.lit(0))
        out = out.withColumn(f"{prefix}{v}", total + (F.coalesce(F.col(v), F.lit(0)) if inclusive else F.lit(0)))
    return out.drop("_pid", *[f"{p}{v}" for v in values for p in ("_off_", "_ex_", "_gs_")])


def with_ordinal(df: DataFrame, order: list, name: str = "pos",
                 n_partitions: int | None = None) -> DataFrame:
    """0-based row index in ``order`` (a total order), computed in parallel."""
    out = prefix_sums(df.withColumn("_one", F.lit(1)), order, ["_one"], prefix="_cum",
                      n_partitions=n_partitions, inclusive=False)
    return out.withColumn(name, F.col("_cum_one").cast("long")).drop("_one", "_cum_one")
