"""The k smallest rows by a hashed key, for k of any size.

``orderBy(...).limit(k)`` brings k rows into one task. Here only counts move: a
histogram over the first hex digits of the key tells in which bucket the k-th
row lies; the bucket is refined by further digits until it is small; rows below
it are kept by a filter, and only the boundary bucket's rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 3  # hex digits a round: 4,096 counts at most come to the driver
FEW = 10_000  # rows that may be sorted in one task


def boundary(df: DataFrame, key: str, k: int, few: int = FEW, width: int = 32) -> tuple[str, int, int]:
    """(prefix, rows below it, rows in it) of the bucket of the k-th smallest
    key; the prefix is as long as needed for at most ``few`` rows in it."""
    prefix, below, inside = "", 0, 0
    while len(prefix) < width:
        size = len(prefix) + DIGITS
        rows = df.where(F.col(key).startswith(prefix)).groupBy(F.substring(key, 1, size).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(rows.collect()):
            if below + r["n"] >= k:
                prefix, inside = r["p"], r["n"]
                break
            below += r["n"]
        if inside <= few:
            break
    return prefix, below, inside


def smallest_k(df: DataFrame, key: Column, tie: str, k: int, *, few: int = FEW) -> DataFrame:
    """The min(k, n) rows with the smallest (``key``, ``tie``); ``key`` is a hash
    in hex digits of equal length, null keys count as the largest. Rows equal in
    both beyond the k-th are any of them."""
    cols = df.columns
    keyed = df.withColumn("_key", F.coalesce(key, F.lit("g" * 32)))
    narrow = keyed.select("_key")
    if k <= 0:
        return df.limit(0)
    if narrow.count() <= k:
        return df
    prefix, below, _ = boundary(narrow, "_key", k, few)
    under = keyed.where(F.col("_key") < prefix)
    edge = keyed.where(F.col("_key").startswith(prefix)).orderBy("_key", tie).limit(k - below)
    return under.unionByName(edge).select(*cols)
