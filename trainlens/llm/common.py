"""Helpers shared by the training-data operators.

Texts travel as Arrow batches. Inside a task they are handled as one byte
buffer plus offsets, cut into pieces of a few megabytes, so NumPy temporaries
stay bounded whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.session import ensure_checkpoint_dir, ship_package

# 0x09-0x0D and 0x20 separate words; every other byte belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

PIECE_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder from the session's setting; package on the workers."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    """How many blocks a keyed shuffle is dealt into (the session's setting,
    which sizes a block's share of the input)."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket(col: Column | str, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def row_key(*cols: Column | str) -> Column:
    """64-bit key of a row's content. Rows that agree in every listed column
    share it, which is what the operators want: equal rows get equal results.
    Nulls take a place of their own."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull() if isinstance(c, str) else c.isNull(), c)])


def buffer_of(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string/binary array; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if arr.null_count:
        arr = arr.fill_null(b"" if "binary" in str(arr.type) else "")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ob, db = arr.buffers()
    off = np.frombuffer(ob, np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8) if db is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about ``limit`` bytes each (one row at least)."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a text buffer: starts, ends (byte positions) and, per text, the
    index of its first word (one more entry than texts)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~SPACE[buf]
    edge = np.zeros(n, bool)
    cuts = off[(off > 0) & (off < n)]
    edge[cuts] = True
    edge[0] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | edge[1:]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def codes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the byte spans [s, e) (ascending, disjoint)."""
    if len(s) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.binary())
    # spans and the gaps between them, alternating, describe the buffer as it
    # lies, so nothing is copied before the dictionary is built
    o = np.empty(2 * len(s) + 1, np.int32)
    o[0:-1:2] = s
    o[1::2] = e
    o[-1] = len(buf)
    arr = pa.Array.from_buffers(pa.binary(), 2 * len(s), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(buf))])
    d = arr.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False)[::2].astype(np.int64), d.dictionary


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of every dictionary entry."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x, seed) for x in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive symbols."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(6364136223846793005) + h[j:j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
