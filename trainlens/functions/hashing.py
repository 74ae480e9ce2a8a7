"""Deterministic, engine-portable ordering and bucketing keys.

Both are built on md5 so that DuckDB (and any SQL engine with md5) reproduces
them byte for byte: ``('0x' || substr(md5(s), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order_key(seed: int, key) -> Column:
    """Seeded pseudo-random sort key for a row: md5 of ``"{seed}:{key}"``.

    Replaces a seeded in-memory shuffle: sorting by it gives a deterministic
    permutation that is independent of partitioning.
    """
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def hash_bucket(seed: int, key, buckets: int) -> Column:
    """Integer in [0, buckets) from the first 32 bits of the seeded md5."""
    h = F.conv(F.substring(seeded_order_key(seed, key), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(buckets))
