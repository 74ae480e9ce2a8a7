"""Exact scores of probes against a large bank, as a tiled product.

Materialising probe x bank pairs as Spark rows is quadratic, so both sides are
cut into pieces of about ``group_bytes``: probes into tiles, the bank into
blocks, both by hash. Tile and block meet in a keyed cogroup, one task's work
per cell, where NumPy scores them and keeps what the caller asked for: the k
best, maxima, counts, ranges, bins or all scores. Nothing passes through the
driver but two sums of sizes, and the plan is the same at every size: a cell
more is a row more of the grid.

* The k best per probe and cell are merged in two levels, first per (probe,
  block modulo ``MERGE``), then per probe, so one probe's candidates from very
  many blocks do not meet in one task.
* Dot products are pruned by Cauchy-Schwarz. The bank is dealt into buckets by
  norm; every probe scores the bucket of the largest norms first, and after that
  only buckets whose largest norm times the probe's reaches its k-th score so
  far. A bucket left out cannot hold a better row, so results stay exact.
* Sparse scores (a sum over shared terms) of few probes are pruned by block maxima:
  a probe scores the blocks whose terms' largest impacts reach its k-th score in the
  block that promises most. Many probes against a large bank would be copied for
  every block; there both sides are written once and read past each other.

Local and final selection use the same total order -- ``round(score, 9)``
descending, then bank id ascending -- so the result is exactly the global top
k. Vectors that are null or hold a null or non-finite component take no part on
either side (``vector_violations`` lists them); vectors of another width than
the probes raise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCORE_DECIMALS = 9
GROUP_BYTES = 64 << 20
LEAST_BLOCK = 1 << 20  # of a block, where there are cores to spare
MERGE = 64
CELLS = 1 << 22  # scores held at once
ADDED = 1 << 20  # scores and additions of a sum over shared terms held at once: one takes some 50 bytes
PROBES = 1024  # scored at once against many rows, so that few scores enter a list
BUCKETS = 64  # of norms, of clusters
SUB_BYTES, PACK_BYTES = 32 << 20, 32 << 20  # of terms, of tokens packed into a value
MERGED = 4096  # documents scored from one value
PACKED = 4  # times smaller, at least, a bank gets by being packed
PACKED_CELL = 3  # groups that both sides of a packed cell may have together
LEVEL = 6  # of compression, for what is copied
CUT = 256 << 10  # bytes of a packed value in a row that is read again and again: the JVM frees smaller objects sooner
PARTS = 5  # columns of such a row: a column's buffer doubles, so a batch of 64 MB in one has 128 MB, in five 80 MB
OFTEN, OFTEN_MOST = 0.05, 2048  # share of the probes that make a term frequent; how many such
PRUNE_FROM = 64  # blocks from which sparse scores are pruned


def is_valid_vector(c: Column | str) -> Column:
    """Not null, and no null or non-finite component."""
    c = F.col(c) if isinstance(c, str) else c
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(c, fine), F.lit(False))


def vector_violations(df: DataFrame, id_col: str, vec_col: str = "vec") -> DataFrame:
    """(id, reason) of the rows whose vector takes no part in scoring."""
    return (df.where(~is_valid_vector(vec_col))
              .select(F.col(id_col).alias("id"),
                      F.when(F.col(vec_col).isNull(), "null vector").otherwise("null or non-finite component").alias("reason")))


def _ids(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    x = col.to_numpy() if isinstance(col, pa.ChunkedArray) else col.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def _rows(ids: pa.Array | pa.ChunkedArray, vecs: pa.Array | pa.ChunkedArray, width: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, matrix, positions) of the rows whose vector takes part. Vectors of
    another ``width`` raise; None takes the first vector's."""
    if isinstance(vecs, pa.ChunkedArray):
        vecs = pa.concat_arrays(vecs.chunks) if vecs.num_chunks else pa.array([], pa.list_(pa.float64()))
    at = np.flatnonzero(vecs.is_valid().to_numpy(zero_copy_only=False))
    vecs = vecs.drop_null()
    size = vecs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vecs.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    ends = np.cumsum(size)
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    good = bad[ends] == bad[ends - size]
    width = int(size[good][0]) if width is None and good.any() else width
    if (size[good] != width).any():
        raise ValueError(f"vectors of width {int(size[good][size[good] != width][0])} among vectors of width {width}")
    m = x[np.repeat(good, size)].reshape(int(good.sum()), width) if good.any() else np.zeros((0, width or 0))
    return _ids(ids)[at[good]], m, at[good]


class _Best:
    """Running k best bank rows for each of some probes. A score is looked at
    closely only where it may still enter its probe's list."""

    def __init__(self, probe_ids: np.ndarray, k: int, exclude_self: bool):
        self.probes, self.k, self.exclude = probe_ids, k, exclude_self
        self.owner, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)
        self.floor = np.full(len(probe_ids), -np.inf)  # a full list's last score, rounded

    def add(self, scores: np.ndarray, bank_ids: np.ndarray) -> None:
        if not scores.size:
            return
        own = self.probes[:, None] == bank_ids[None, :] if self.exclude else None
        cut = self.floor
        more = self.k + (int(own.sum(1).max()) if self.exclude else 0)
        if scores.shape[1] > more and np.isneginf(cut).any():  # so many of this call are enough
            cut = np.maximum(cut, np.partition(scores, scores.shape[1] - more, axis=1)[:, scores.shape[1] - more])
        may = scores >= (cut - 1e-9 - 1e-12 * np.abs(np.where(np.isinf(cut), 0, cut)))[:, None]
        if self.exclude:
            may &= ~own
        p, j = np.nonzero(may)
        near = np.round(scores[p, j], SCORE_DECIMALS) >= self.floor[p]
        p, j = p[near], j[near]
        if not len(p):
            return
        # the lists of these probes anew
        touched = np.zeros(len(self.probes), bool)
        touched[p] = True
        old = touched[self.owner]
        new_ids = bank_ids[j]
        owner = np.concatenate([self.owner[old], p])
        ids = new_ids if self.ids is None else np.concatenate([self.ids[old], new_ids])
        score = np.concatenate([self.scores[old], scores[p, j]])
        o = np.lexsort((ids, -np.round(score, SCORE_DECIMALS), owner))
        owner, ids, score = owner[o], ids[o], score[o]
        first = np.searchsorted(owner, owner)
        keep = np.arange(len(owner)) - first < self.k
        owner, ids, score = owner[keep], ids[keep], score[keep]
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        full = last[np.bincount(owner, minlength=len(self.probes))[owner[last]] == self.k]
        self.floor[owner[full]] = np.round(score[full], SCORE_DECIMALS)
        self.ids = ids if self.ids is None else np.concatenate([self.ids[~old], ids])
        self.owner, self.scores = np.concatenate([self.owner[~old], owner]), np.concatenate([self.scores[~old], score])

    def table(self, schema: pa.Schema, block: int) -> pa.Table:
        if not len(self.owner):
            return schema.empty_table()
        cols = [self.probes[self.owner], self.ids, self.scores, np.full(len(self.owner), block % MERGE, np.int32)]
        return pa.table([pa.array(c).cast(t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)


def _merge(local: DataFrame, k: int, blocks: int | None = None) -> DataFrame:
    """The k best of every probe. Of ``MERGE`` blocks or fewer, each has a source of
    its own with k rows at most, which the first level would only shuffle."""
    best = [F.round("score", SCORE_DECIMALS).desc(), F.col("bank_id").asc()]
    part = Window.partitionBy("probe_id", "_src").orderBy(*best)
    whole = Window.partitionBy("probe_id").orderBy(*best)
    one_level = blocks is not None and blocks <= MERGE
    few = local if one_level else local.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return (few.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
               .select("probe_id", "bank_id", "score", "rank"))


def _types(probes: DataFrame, bank: DataFrame) -> tuple[T.StructType, pa.Schema]:
    out = T.StructType([T.StructField("probe_id", probes.schema["probe_id"].dataType),
                        T.StructField("bank_id", bank.schema["bank_id"].dataType),
                        T.StructField("score", T.DoubleType()), T.StructField("_src", T.IntegerType())])
    return out, _arrow(out)


def _normalized(m: np.ndarray) -> np.ndarray:
    return m / np.clip(np.linalg.norm(m, axis=1, keepdims=True), 1e-12, None)


def _steps(n_probes: int, n_rows: int, cells: int = CELLS) -> Iterator[slice]:
    """Slices of bank rows whose scores fit ``cells``."""
    step = max(1, cells // max(1, n_probes))
    return (slice(a, a + step) for a in range(0, n_rows, step))


def _vector_bytes(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) * 8 + 16


def _pieces(df: DataFrame, size: Column, group_bytes: int, least: int | None = None) -> int:
    """How many pieces of ``group_bytes`` the rows make; with ``least`` also
    enough to use the cores, as long as a piece has that many bytes."""
    total = df.agg(F.sum(size)).first()[0] or 0
    n = math.ceil(total / group_bytes)
    if least:
        n = max(n, min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / least)))
    return max(1, n)


def _by_hash(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _all_of(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _cells(left: DataFrame, right: DataFrame, cells: int, body: Callable[[int, pa.Table, pa.Table], pa.Table],
           schema: T.StructType, parts: int | None = None) -> DataFrame:
    """``body`` over every (tile, block) both sides have. Cells are few bytes
    and much work, so their number of partitions is given and not left to
    adaptive coalescing."""
    n = parts or min(4 * cells, 100_000)
    out = _arrow(schema)

    def run(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return out.empty_table()
        return body(key[1].as_py(), a, b).cast(out)
    keyed = lambda df: df.repartition(n, "tile", "block").groupBy("tile", "block")
    return keyed(left).cogroup(keyed(right)).applyInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}
    return pa.schema([(f.name, kinds.get(f.dataType, pa.float64())) for f in schema.fields])


def _tiles(probes: DataFrame, group_bytes: int, *extra: str) -> tuple[DataFrame, int]:
    p = probes.select("probe_id", "vec", *extra)
    n = _pieces(p, _vector_bytes("vec"), group_bytes)
    return p.withColumn("tile", _by_hash(n, "probe_id")), n


def _product(probes: DataFrame, bank: DataFrame, group_bytes: int, body: Callable, schema: T.StructType, *extra: str,
             least: int | None = LEAST_BLOCK) -> DataFrame:
    """``body(block, probe table, probe ids, probe matrix, bank ids, bank
    matrix)`` over the whole grid of tiles and blocks."""
    p, tiles = _tiles(probes, group_bytes, *extra)
    b = bank.select("bank_id", "vec")
    blocks = _pieces(b, _vector_bytes("vec"), group_bytes, least)
    return _cells(p.withColumn("block", _all_of(blocks)), b.withColumn("block", _by_hash(blocks, "bank_id", "vec")).withColumn("tile", _all_of(tiles)),
                  tiles * blocks, _dense(body, schema), schema)


def _dense(body: Callable, schema: T.StructType) -> Callable[[int, pa.Table, pa.Table], pa.Table]:
    def run(block: int, a: pa.Table, b: pa.Table) -> pa.Table:
        ids, m, at = _rows(a.column("probe_id"), a.column("vec"), None)
        if not len(ids):
            return _arrow(schema).empty_table()
        own, rows, _ = _rows(b.column("bank_id"), b.column("vec"), m.shape[1])
        return body(block, a.take(pa.array(at)), ids, m, own, rows)
    return run


def _topk_body(k: int, exclude_self: bool, arrow: pa.Schema, shape: Callable[[np.ndarray], np.ndarray] = lambda m: m) -> Callable:
    def body(block, _, ids, m, own, rows):
        m, rows, out = shape(m), shape(rows), []
        for a in range(0, len(ids), PROBES):
            best, part = _Best(ids[a:a + PROBES], k, exclude_self), m[a:a + PROBES]
            for s in _steps(len(part), len(own)):
                best.add(part @ rows[s].T, own[s])
            out.append(best.table(arrow, block))
        return pa.concat_tables(out) if out else arrow.empty_table()
    return body


def dense_topk(probes: DataFrame, bank: DataFrame, k: int, *, metric: str = "dot",
               exclude_self: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Top-k bank rows per probe by dot product or cosine of vectors.

    ``probes``: (probe_id, vec ARRAY<numeric>); ``bank``: (bank_id, vec).
    Returns (probe_id, bank_id, score DOUBLE, rank INT), rank from 1.
    Cosine divides by the norm clipped at 1e-12.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    schema, arrow = _types(probes, bank)
    if metric == "cosine":  # all norms are one: nothing to prune by
        return _merge(_product(probes, bank, group_bytes, _topk_body(k, exclude_self, arrow, _normalized), schema), k)
    first, rest = pruned_cells(probes, bank, k, exclude_self=exclude_self, group_bytes=group_bytes)
    local = first if rest is None else first.unionByName(_scored(*rest, _topk_body(k, exclude_self, arrow), schema))
    return _merge(local, k)


def _norm(c: str) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _above(cuts: list[float], c: str) -> Column:
    """How many of ``cuts`` are larger than the column, which is computed once a
    row: an expression inside a lambda is computed for every element."""
    if not cuts:
        return F.lit(0)
    larger = F.zip_with(F.array(*[F.lit(float(x)) for x in cuts]), F.array_repeat(F.col(c), len(cuts)), lambda x, y: (x > y).cast("int"))
    return F.aggregate(larger, F.lit(0), lambda a, x: a + x)


def _scored(left: DataFrame, right: DataFrame, cells: int, body: Callable, schema: T.StructType) -> DataFrame:
    return _cells(left, right, cells, _dense(body, schema), schema)


def pruned_cells(probes: DataFrame, bank: DataFrame, k: int, *, exclude_self: bool = False,
                 group_bytes: int = GROUP_BYTES) -> tuple[DataFrame, tuple[DataFrame, DataFrame, int] | None]:
    """The k best of every probe in the bucket of the largest norms, and what
    else must be scored: (probe_id, vec, tile, block, bucket) with the bank rows
    of those cells, and how many there are at most. None where one block holds
    the whole bank."""
    schema, arrow = _types(probes, bank)
    b = bank.select("bank_id", "vec").where(is_valid_vector("vec"))
    width, total = b.agg(F.min(F.size("vec")).alias("least"), F.max(F.size("vec")).alias("most")), _vector_bytes("vec")
    blocks = _pieces(b, total, group_bytes, LEAST_BLOCK)
    body = _topk_body(k, exclude_self, arrow)
    if blocks == 1:
        return _product(probes, bank, group_bytes, body, schema), None
    low, high = width.first()
    if low != high:
        raise ValueError(f"vectors of width {low} among vectors of width {high}")
    p, tiles = _tiles(probes.where(is_valid_vector("vec")), group_bytes)
    p, b = p.withColumn("norm", _norm("vec")), b.withColumn("norm", _norm("vec"))
    n = min(BUCKETS, blocks)
    cuts = b.agg(F.percentile_approx("norm", [1 - (i + 1) / n for i in range(n - 1)], 1000)).first()[0]
    cuts = sorted(set(cuts), reverse=True)
    b = b.withColumn("bucket", _above(cuts, "norm"))  # 0: the largest norms
    found = {r["bucket"]: r for r in b.groupBy("bucket").agg(F.max("norm").alias("most"), F.sum(total).alias("bytes")).collect()}
    # buckets become runs of blocks: (bucket, first block, last block, largest norm)
    runs, at = [], 0
    for i in sorted(found):
        size = max(1, math.ceil(found[i]["bytes"] / group_bytes))
        runs.append((i, at, at + size - 1, float(found[i]["most"])))
        at += size
    table = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(r, ("bucket", "first", "last", "most"), strict=True)]) for r in runs])
    at_of = {r[0]: i for i, r in enumerate(runs)}
    # a row of a bucket that held none when they were counted cannot be
    mine = F.element_at(F.array(*[table[at_of.get(i, 0)] for i in range(len(cuts) + 1)]), F.col("bucket") + 1)
    b = (b.withColumn("_run", mine).withColumn("block", (F.col("_run.first") + F.pmod(
        F.xxhash64("bank_id", "vec"), F.col("_run.last") - F.col("_run.first") + 1)).cast("int")).select("bank_id", "vec", "block"))

    def side(df: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
        """A row of ``df`` for every block of the buckets that pass ``test``."""
        return (df.withColumn("_run", F.explode(F.filter(table, test)))
                .select("probe_id", "vec", "tile", F.col("_run.bucket").alias("bucket"), F.explode(F.sequence("_run.first", "_run.last")).alias("block")))

    head = runs[0]
    left = side(p, lambda x: x["bucket"] == head[0])
    first = _scored(left, b.where(F.col("block") <= head[2]).withColumn("tile", _all_of(tiles)), tiles * (head[2] + 1), body, schema).checkpoint()
    # a probe's k-th score so far; with fewer than k every bucket is open
    so_far = _merge(first, k).groupBy("probe_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.round("least", SCORE_DECIMALS)).otherwise(F.lit(float("-inf")))
    # (the norm comes from below the join, so no bucket computes it again)
    open_ = p.join(so_far.select("probe_id", floor.alias("floor")), "probe_id", "left")
    # scores are compared rounded, which the slack allows for
    reach = lambda x: F.col("norm") * x["most"] * (1 + 1e-12) + 1e-9
    left = side(open_, lambda x: (x["bucket"] > head[0]) & (
        F.col("floor").isNull() | (reach(x) >= F.col("floor")))).checkpoint()
    need = left.select(F.col("tile").alias("to_tile"), F.col("block").alias("to_block")).distinct()
    right = b.join(need, b["block"] == need["to_block"]).select("bank_id", "vec", F.col("to_tile").alias("tile"), F.col("to_block").alias("block"))
    return first, (left, right, tiles * at)


def dense_scores(probes: DataFrame, bank: DataFrame, *, rows: int = 2000) -> DataFrame:
    """(probe_id, bank_id, score): every score. Cells have about ``rows`` probes
    and bank rows, so a cell's scores stay a few million."""
    schema, _ = _types(probes, bank)
    schema = T.StructType(schema.fields[:3])

    def body(_, __, ids, m, own, x):
        return pa.table([pa.array(np.repeat(ids, len(own))), pa.array(np.tile(own, len(ids))), pa.array((m @ x.T).ravel())], names=schema.names)
    width = bank.agg(F.max(F.size("vec"))).first()[0] or 1
    return _product(probes, bank, rows * (width * 8 + 16), body, schema, least=None)


def dense_max(probes: DataFrame, bank: DataFrame, *, exclude_self: bool = False,
              group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(probe_id, max_cosine, max_dot): each probe's strongest bank match under
    both measures in one pass (per-cell maxima, then their maximum)."""
    schema = T.StructType([probes.schema["probe_id"], T.StructField("max_cosine", T.DoubleType()), T.StructField("max_dot", T.DoubleType())])

    def body(_, __, ids, m, own, rows):
        norm = np.clip(np.linalg.norm(m, axis=1), 1e-12, None)[:, None]
        size = np.clip(np.linalg.norm(rows, axis=1), 1e-12, None)
        top = np.full((2, len(ids)), -np.inf)
        for s in _steps(len(ids), len(own)):
            dots = m @ rows[s].T
            if exclude_self:
                dots[ids[:, None] == own[None, s]] = -np.inf
            if dots.shape[1]:
                top[0] = np.maximum(top[0], (dots / norm / size[None, s]).max(1))
                top[1] = np.maximum(top[1], dots.max(1))
        met = np.isfinite(top[1])
        return pa.table([pa.array(ids[met]), pa.array(top[0][met]), pa.array(top[1][met])], names=schema.names)
    local = _product(probes, bank, group_bytes, body, schema)
    return local.groupBy("probe_id").agg(F.max("max_cosine").alias("max_cosine"), F.max("max_dot").alias("max_dot"))


def dense_count_at_least(probes: DataFrame, bank: DataFrame, *, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(probe_id, n_at_least, n_bank, sum_score): per probe, how many bank dot
    scores reach its threshold ``thr``, plus the count and sum of all scores.

    ``probes``: (probe_id, vec, thr); ``bank``: (bank_id, vec).
    """
    schema = T.StructType([probes.schema["probe_id"], T.StructField("n_at_least", T.LongType()),
                           T.StructField("n_bank", T.LongType()), T.StructField("sum_score", T.DoubleType())])

    def body(_, table, ids, m, own, rows):
        thr = table.column("thr").to_numpy().astype(np.float64)[:, None]
        reach, total = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for s in _steps(len(ids), len(rows)):
            dots = m @ rows[s].T
            reach += (np.round(dots, SCORE_DECIMALS) >= thr).sum(1)
            total += dots.sum(1)
        return pa.table([pa.array(ids), pa.array(reach), pa.array(np.full(len(ids), len(rows))), pa.array(total)], names=schema.names)
    local = _product(probes, bank, group_bytes, body, schema, "thr")
    return local.groupBy("probe_id").agg(F.sum("n_at_least").alias("n_at_least"), F.sum("n_bank").alias("n_bank"),
                                         F.sum("sum_score").alias("sum_score"))


def dense_range(probes: DataFrame, bank: DataFrame, *, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(probe_id, least, most): the range of each probe's rounded dot scores."""
    schema = T.StructType([probes.schema["probe_id"], T.StructField("least", T.DoubleType()), T.StructField("most", T.DoubleType())])

    def body(_, __, ids, m, own, rows):
        least, most = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
        for s in _steps(len(ids), len(rows)):
            dots = np.round(m @ rows[s].T, SCORE_DECIMALS)
            least, most = np.minimum(least, dots.min(1)), np.maximum(most, dots.max(1))
        met = np.isfinite(least)
        return pa.table([pa.array(ids[met]), pa.array(least[met]), pa.array(most[met])], names=schema.names)
    local = _product(probes, bank, group_bytes, body, schema)
    return local.groupBy("probe_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def dense_histogram(probes: DataFrame, bank: DataFrame, bins: int, *, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(probe_id, bin, count): each probe's rounded dot scores in ``bins`` equal
    bins over its own [lo, hi]; bins without scores have no row.

    ``probes``: (probe_id, vec, lo, hi); ``bank``: (bank_id, vec).
    """
    schema = T.StructType([probes.schema["probe_id"], T.StructField("bin", T.IntegerType()), T.StructField("count", T.LongType())])

    def body(_, table, ids, m, own, rows):
        lo, hi = (table.column(c).to_numpy().astype(np.float64)[:, None] for c in ("lo", "hi"))
        count, size = np.zeros((len(ids), bins), np.int64), (hi - lo) / bins
        for s in _steps(len(ids), len(rows)):
            dots = np.round(m @ rows[s].T, SCORE_DECIMALS)
            at = np.clip(np.floor((dots - lo) / size), 0, bins - 1).astype(np.int64)
            count += np.bincount((at + bins * np.arange(len(ids))[:, None]).ravel(), minlength=count.size).reshape(count.shape)
        p, b = np.nonzero(count)
        return pa.table([pa.array(ids[p]), pa.array(b.astype(np.int32)), pa.array(count[p, b])], names=schema.names)
    local = _product(probes, bank, group_bytes, body, schema, "lo", "hi")
    return local.groupBy("probe_id", "bin").agg(F.sum("count").alias("count"))


Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


class _Terms:
    """The terms of some probes: who holds each, with which weight. The terms
    that many of them hold are also a matrix, so that BLAS adds them up."""

    def __init__(self, probe_ids: np.ndarray, terms: pa.Array, weight: np.ndarray):
        self.ids = np.unique(probe_ids)
        has = terms.is_valid().to_numpy(zero_copy_only=False)
        enc = terms.drop_null().dictionary_encode()
        code = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        o = np.argsort(code, kind="stable")
        self.dictionary, self.vocab = enc.dictionary, max(1, len(enc.dictionary))
        self.first = np.searchsorted(code[o], np.arange(self.vocab + 1))
        self.owner, self.weight = np.searchsorted(self.ids, probe_ids[has])[o], weight[has][o]
        held = np.diff(self.first)
        top = np.argsort(-held, kind="stable")[:OFTEN_MOST]
        top = np.sort(top[held[top] > OFTEN * max(8, len(self.ids))])
        self.column = np.full(self.vocab, -1)
        self.column[top] = np.arange(len(top))
        self.often = np.zeros((len(self.ids), len(top)))
        for i, t in enumerate(top.tolist()):
            q = slice(self.first[t], self.first[t + 1])
            np.add.at(self.often[:, i], self.owner[q], self.weight[q])

    def score(self, best: _Best, own: np.ndarray, doc: np.ndarray, term: np.ndarray, w: np.ndarray) -> None:
        """Adds the documents ``own`` whose entries (doc, term, w) are in order of doc."""
        for s in _steps(len(self.ids), len(own), ADDED):
            x, y = np.searchsorted(doc, [s.start, s.stop])
            width = min(s.stop, len(own)) - s.start
            col = self.column[term[x:y]]
            often = col >= 0
            if often.any():
                m = np.zeros((self.often.shape[1], width))
                m[col[often], doc[x:y][often] - s.start] = w[x:y][often]
                scores = (self.often @ m).ravel()
            else:
                scores = np.zeros(len(self.ids) * width)
            # one addition for each probe that holds an entry's term
            rare = np.flatnonzero(~often) + x
            many = np.diff(self.first)[term[rare]]
            ends = np.cumsum(many)
            at = 0
            while at < len(rare):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ADDED, side="right")))
                some, c = rare[at:to], many[at:to]
                begin = np.cumsum(c) - c
                pos = np.arange(int(c.sum())) + np.repeat(self.first[term[some]] - begin, c)
                cell = self.owner[pos] * width + np.repeat(doc[some] - s.start, c)
                scores += np.bincount(cell, self.weight[pos] * np.repeat(w[some], c), minlength=len(scores))
                at = to
            best.add(scores.reshape(len(self.ids), width), own[s])


def _entries(tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, dictionary, document, term, count) of lists of tokens, in order
    of document and term."""
    size = tokens.value_lengths().to_numpy(zero_copy_only=False)
    enc = tokens.flatten().dictionary_encode()
    vocab = max(1, len(enc.dictionary))
    at = enc.indices.is_valid().to_numpy(zero_copy_only=False)
    code = enc.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[at]
    pair, tf = np.unique(np.repeat(np.arange(len(size)), size)[at] * vocab + code, return_counts=True)
    return size, enc.dictionary, pair // vocab, pair % vocab, tf


def term_counts(rows: DataFrame) -> DataFrame:
    """(probe_id, term, count) of (probe_id, tokens): a row for each term of each row,
    counted where the row is."""
    out = T.StructType([rows.schema["probe_id"], T.StructField("term", T.StringType()), T.StructField("count", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                some = batch.slice(a, 1024)
                _, dictionary, doc, term, tf = _entries(some.column(1))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(doc)), dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], out.names)
    return rows.select("probe_id", _tokens_column()).mapInArrow(run, out)


def _known(dictionary: pa.Array, terms: _Terms, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries whose term some probe has, with that term's number there."""
    found = pc.index_in(dictionary, value_set=terms.dictionary)
    number = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    hit = number[term] >= 0 if len(number) else np.zeros(0, bool)
    return doc[hit], number[term[hit]] if len(number) else term, tf[hit]


def _sparse_body(k: int, weigh: Weigh, arrow: pa.Schema) -> Callable[[int, pa.Table, pa.Table], pa.Table]:
    """Scores a block's documents for a tile's probes, term by term."""
    def body(block: int, a: pa.Table, b: pa.Table) -> pa.Table:
        terms = _Terms(_ids(a.column("probe_id")), pa.concat_arrays(a.column("term").chunks), a.column("weight").to_numpy())
        best = _Best(terms.ids, k, False)
        for batch in b.select(["bank_id", "tokens"]).to_batches(max_chunksize=4096):
            size, dictionary, doc, term, tf = _entries(batch.column(1))
            doc, term, tf = _known(dictionary, terms, doc, term, tf)
            terms.score(best, _ids(batch.column(0)), doc, term, weigh(tf.astype(np.float64), size[doc].astype(np.float64)))
        return best.table(arrow, block)
    return body


def _blob(level: int, **columns: pa.Array) -> bytes:
    """Arrays of any lengths as one compressed value."""
    row = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns.values()]
    batch, sink = pa.RecordBatch.from_arrays(row, list(columns)), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unblob(raw: bytes) -> list[pa.Array]:
    with pa.ipc.open_stream(raw) as rows:
        return [c.flatten() for c in rows.read_next_batch().columns]


def _whole(c: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _planes(x: np.ndarray) -> pa.Array:
    """Small numbers byte by byte, all lowest bytes first: what compresses best."""
    return pa.array(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).ravel())


def _numbers(planes: pa.Array) -> np.ndarray:
    return np.ascontiguousarray(planes.to_numpy().reshape(4, -1).T).view("<i4").ravel()


def _pack_terms(t: pa.Table) -> pa.Table:
    """All terms of a part's probes in one value; terms and weights as numbers, in
    order of term, so that a term is told by how many rows it has (``many``; the
    null term's rows come last)."""
    t = t.sort_by([("term", "ascending"), ("probe_id", "ascending")])
    term, weight = _whole(t.column("term")), _whole(t.column("weight")).dictionary_encode()
    code = term.drop_null().dictionary_encode()
    ids = pc.unique(t.column("probe_id"))
    ids = ids.take(pc.array_sort_indices(ids))
    probe = pc.index_in(t.column("probe_id"), value_set=ids)
    many = np.bincount(code.indices.to_numpy(), minlength=len(code.dictionary))
    raw = _blob(LEVEL, ids=ids, probe=_planes(probe.to_numpy()), terms=code.dictionary, many=_planes(many),
                weights=weight.dictionary, weight=_planes(weight.indices.to_numpy()))
    return pa.table({"sub": t.column("sub").slice(0, 1), "blob": pa.array([raw], pa.binary())})


def _unpack_terms(raw: bytes) -> _Terms:
    ids, probe, names, many, weights, weight = _unblob(raw)
    probe = _numbers(probe)
    term = np.repeat(np.arange(len(names)), _numbers(many))
    terms = pa.concat_arrays([names.take(pa.array(term)), pa.nulls(len(probe) - len(term), names.type)])
    return _Terms(_ids(ids)[probe], terms, weights.to_numpy()[_numbers(weight)])


def _doc_blob(ids: pa.Array, size: np.ndarray, dictionary: pa.Array, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, level: int = 1) -> bytes:
    return _blob(level, ids=ids, size=_planes(size), many=_planes(np.bincount(doc, minlength=len(ids))),
                 terms=dictionary, step=_planes(np.diff(term, prepend=0)), tf=_planes(tf))


def _unpack_docs(raw: bytes) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, lengths, dictionary, document, term, count)."""
    ids, size, many, dictionary, step, tf = _unblob(raw)
    return ids, _numbers(size), dictionary, np.repeat(np.arange(len(ids)), _numbers(many)), np.cumsum(_numbers(step), dtype=np.int64), _numbers(tf)


def _merge_docs(blobs: Iterator[bytes]) -> Iterator[bytes]:
    """Values of ``MERGED`` documents or more: a block's come in as many pieces as
    there were tasks, and every value costs a look at all of a probe side's terms."""
    held, n = [], 0

    def whole() -> bytes:
        ids, size, names, doc, term, tf = zip(*held, strict=True)
        code = pa.concat_arrays(names).dictionary_encode()
        at, number = np.cumsum([0, *map(len, names)]), code.indices.to_numpy()
        first = np.cumsum([0, *map(len, ids)])
        return _doc_blob(pa.concat_arrays(ids), np.concatenate(size), code.dictionary, np.concatenate([d + a for d, a in zip(doc, first, strict=False)]),
                         np.concatenate([number[t + a] for t, a in zip(term, at, strict=False)]), np.concatenate(tf))
    for raw in blobs:
        held.append(_unpack_docs(raw))
        n += len(held[-1][0])
        if n >= MERGED:
            yield raw if len(held) == 1 else whole()
            held, n = [], 0
    if held:
        yield whole()


def _pack_docs(batches: Iterator[pa.RecordBatch], most: int = MERGED) -> Iterator[pa.RecordBatch]:
    """(block, blob): documents of a block with their terms' counts. A document's
    block is given, so it does not matter which ones share a value."""
    def packed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        block = t.column("block").to_numpy()
        for i in np.unique(block).tolist():
            at = np.flatnonzero(block == i)
            for a in range(0, len(at), most):
                some = t.take(pa.array(at[a:a + most]))
                size, dictionary, doc, term, tf = _entries(_whole(some.column("tokens")))
                raw = _doc_blob(_whole(some.column("bank_id")), size, dictionary, doc, term, tf, LEVEL)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([raw], pa.binary())], ["block", "blob"])
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PACK_BYTES:
            yield from packed(pa.Table.from_batches(held))
            held, size = [], 0
    if held:
        yield from packed(pa.Table.from_batches(held))


def _packed_body(k: int, weigh: Weigh, arrow: pa.Schema) -> Callable[[int, pa.Table, pa.Table], pa.Table]:
    """``_sparse_body`` over packed sides, one value of each at a time."""
    def body(block: int, a: pa.Table, b: pa.Table) -> pa.Table:
        out, parts = [], list(_merge_docs(x.as_py() for x in b.column("blob")))
        for raw in a.column("blob"):
            terms = _unpack_terms(raw.as_py())
            best = _Best(terms.ids, k, False)
            for part in parts:
                own, size, dictionary, doc, term, tf = _unpack_docs(part)
                doc, term, tf = _known(dictionary, terms, doc, term, tf)
                terms.score(best, _ids(own), doc, term, weigh(tf.astype(np.float64), size[doc].astype(np.float64)))
            out.append(best.table(arrow, block))
        return pa.concat_tables(out)
    return body


def _term_rows(probe_ids: DataFrame, probe_terms: DataFrame) -> DataFrame:
    """(probe_id, term, weight), with a null term for every probe."""
    return (probe_ids.select("probe_id", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight")).distinct()
            .unionByName(probe_terms.select("probe_id", "term", F.col("weight").cast("double").alias("weight")).where("term IS NOT NULL AND weight IS NOT NULL")))


def _tokens_column() -> Column:
    return F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")


def _impacts(weigh: Weigh) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(block, term, impact): a batch's largest weight of every term per block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = b.column(0).to_numpy(zero_copy_only=False)
            size, dictionary, doc, term, tf = _entries(b.column(1))
            vocab = max(1, len(dictionary))
            w = weigh(tf.astype(np.float64), size[doc].astype(np.float64))
            cell, inv = np.unique(block[doc].astype(np.int64) * vocab + term, return_inverse=True)
            most = np.full(len(cell), -np.inf)
            np.maximum.at(most, inv, w)
            yield pa.RecordBatch.from_arrays([pa.array((cell // vocab).astype(np.int32)), dictionary.take(pa.array(cell % vocab)), pa.array(most)],
                                             ["block", "term", "impact"])
    return run


def block_bounds(rows: DataFrame, docs: DataFrame, weigh: Weigh) -> DataFrame:
    """(probe_id, block, bound): no document of the block scores more for the
    probe. ``docs``: (bank_id, tokens, block). Blocks without a term of the probe
    that has a positive weight have no row; their bound is 0."""
    asked = rows.where("weight > 0").select("probe_id", "term", "weight")
    impacts = (docs.select("block", "tokens").mapInArrow(_impacts(weigh), "block int, term string, impact double")
               .join(asked.select("term").distinct(), "term", "left_semi").groupBy("block", "term").agg(F.max("impact").alias("impact")))
    return asked.join(impacts, "term").groupBy("probe_id", "block").agg(F.sum(F.col("weight") * F.col("impact")).alias("bound"))


def _blocks_of(docs: DataFrame, blocks: int) -> DataFrame:
    """``block`` of every document: by hash, and within runs of blocks for the
    values of ``cluster`` where the bank has that column."""
    if "cluster" not in docs.columns:
        return docs.withColumn("block", _by_hash(blocks, "bank_id"))
    keyed = docs.withColumn("_b", _by_hash(BUCKETS, "cluster"))
    sizes = {r["_b"]: r["count"] for r in keyed.groupBy("_b").count().collect()}
    total, at, first, many = max(1, sum(sizes.values())), 0, [0] * BUCKETS, [1] * BUCKETS
    for i in sorted(sizes):
        first[i], many[i] = at, max(1, round(blocks * sizes[i] / total))
        at += many[i]
    place = lambda x: F.element_at(F.array(*[F.lit(v) for v in x]), F.col("_b") + 1)
    return keyed.withColumn("block", (place(first) + F.pmod(F.xxhash64("bank_id"), place(many))).cast("int")).drop("_b", "cluster")


def open_blocks(rows: DataFrame, keyed: DataFrame, k: int, weigh: Weigh, scored: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The k best of every probe in its most promising block, and (probe_id,
    block) of the other blocks it must score. ``scored`` scores such pairs."""
    bounds = block_bounds(rows, keyed, weigh).checkpoint()
    best = bounds.groupBy("probe_id").agg(F.max_by("block", F.struct("bound", -F.col("block"))).alias("block"))
    first = scored(best).checkpoint()
    so_far = _merge(first, k).groupBy("probe_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    floor = F.when(F.col("n") >= k, F.round("least", SCORE_DECIMALS)).otherwise(F.lit(float("-inf")))
    known = (rows.select("probe_id").distinct().join(so_far.select("probe_id", floor.alias("floor")), "probe_id", "left")
             .join(best.withColumnRenamed("block", "done"), "probe_id", "left")).checkpoint()
    # scores are compared rounded, which the slack allows for; with a floor of 0
    # documents that share no term may still fill the list by lowest id
    tight = F.coalesce(F.col("floor") > 1e-8, F.lit(False))
    some = (bounds.join(known.where(tight), "probe_id")
            .where((F.col("block") != F.col("done")) & (F.col("bound") * (1 + 1e-9) + 1e-8 >= F.col("floor"))).select("probe_id", "block"))
    every = keyed.select("block").distinct().agg(F.collect_set("block").alias("all"))
    rest = known.where(~tight).withColumn("_all", every.scalar()).select("probe_id", "done", F.explode("_all").alias("block"))
    return first, some.unionByName(rest.where("done IS NULL OR block <> done").select("probe_id", "block")).checkpoint()


def _grid(left: int, right: int, cell: float, cores: int, most: int) -> tuple[int, int]:
    """(tiles, blocks) that copy the fewest bytes: the left side goes to every block,
    the right side to every tile, and both sides of a cell have about ``cell`` bytes
    together. There are ``most`` tiles at most; few cells fill the ``cores`` evenly."""
    def blocks(tiles: int) -> int:
        n = max(math.ceil(right / max(cell - left / tiles, cell / 8)), math.ceil(cores / tiles), 1)
        return math.ceil(math.ceil(n * tiles / cores) * cores / tiles) if n * tiles < 4 * cores else n
    fits = [t for t in range(1, most) if left / t <= cell * 7 / 8]
    return min(((t, blocks(t)) for t in [*fits, most]), key=lambda x: left * x[1] + right * x[0])


def _apart(spark: SparkSession, tiles: int, blocks: int) -> int:
    """A number of partitions over which few cells spread without meeting: two large
    cells in one task take twice the time."""
    cells = tiles * blocks
    if cells > 256:
        return min(4 * cells, 100_000)
    at = F.col("id").cast("int")
    keys = [r[0] for r in spark.range(cells).select(F.hash(F.floor(at / blocks).cast("int"), at % blocks)).collect()]
    return max(range(4 * cells, 8 * cells + 1), key=lambda n: (len({x % n for x in keys}), -n))


def _packed_cells(rows: DataFrame, row_bytes: int, docs: DataFrame, doc_bytes: int, cores: int, group_bytes: int, body: Callable,
                  schema: T.StructType) -> tuple[DataFrame, int]:
    """``body`` over the grid, whose sides are packed before they are copied: all
    terms of a probe in one value, documents by block. What a block or tile is
    counted by, and what is shuffled for each cell, are the packed bytes. Also the
    number of blocks."""
    subs = max(1, math.ceil(row_bytes / min(SUB_BYTES, group_bytes)))
    packed = (rows.withColumn("sub", _by_hash(subs, "probe_id")).groupBy("sub").applyInArrow(_pack_terms, "sub int, blob binary").checkpoint())
    size = packed.agg(F.sum(F.octet_length("blob") + 16)).first()[0] or 0
    tiles, blocks = _grid(size, doc_bytes, PACKED_CELL * group_bytes, cores, subs)
    left = packed.select("blob", F.pmod("sub", F.lit(tiles)).alias("tile"), _all_of(blocks).alias("block"))
    right = (docs.select("bank_id", "tokens", _by_hash(blocks, "bank_id").alias("block")).mapInArrow(_pack_docs, "block int, blob binary")
             .withColumn("tile", _all_of(tiles)))
    return _cells(left, right, tiles * blocks, body, schema, _apart(rows.sparkSession, tiles, blocks)), blocks


def _pack_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(docs0, .., last): the values of ``_pack_docs``, half as large, as rows of
    ``CUT`` bytes in ``PARTS`` columns."""
    step = math.ceil(CUT / PARTS)
    for b in _pack_docs(batches, MERGED // 2):
        for raw in b.column(1).to_pylist():
            for a in range(0, len(raw), step * PARTS):
                parts = [pa.array([raw[x:x + step]], pa.binary()) for x in range(a, a + step * PARTS, step)]
                yield pa.RecordBatch.from_arrays([*parts, pa.array([a + step * PARTS >= len(raw)])], [*_parts(), "last"])


def _parts() -> list[str]:
    return [f"docs{i}" for i in range(PARTS)]


def _streamed_body(k: int, weigh: Weigh, arrow: pa.Schema, subs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores a stream of (sub, terms, docs0, .., last) rows and keeps the k best of
    all. A sub's terms come with the first row only."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        while (b := next(batches, None)) is not None:
            for i in range(len(b)):
                yield tuple(c[i].as_py() for c in b.columns)
            del b  # before the next one is read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut = {}, {}
        for sub, probes, *docs, last in rows(iter(batches)):
            if probes is not None:
                terms = _unpack_terms(probes)
                held[sub], cut[sub] = (terms, _Best(terms.ids, k, False)), []
            cut[sub] += docs
            if last:
                terms, best = held[sub]
                own, size, dictionary, doc, term, tf = _unpack_docs(b"".join(cut[sub]))
                cut[sub] = []
                doc, term, tf = _known(dictionary, terms, doc, term, tf)
                terms.score(best, _ids(own), doc, term, weigh(tf.astype(np.float64), size[doc].astype(np.float64)))
        source = TaskContext.get().partitionId() // subs
        for _, best in held.values():
            yield from best.table(arrow, source).to_batches()
    return run


def _streamed(rows: DataFrame, row_bytes: int, docs: DataFrame, cores: int, group_bytes: int, k: int, weigh: Weigh,
              schema: T.StructType) -> tuple[DataFrame, int]:
    """The k best of every probe in each group of documents, and the number of groups.

    Both sides are packed and written once. A task takes one value of terms and reads
    the documents of a group past it from where they are written (a product of
    partitions, no exchange), so nothing is copied for a pair of pieces on disk, and
    candidates are k for each probe and group, of which there are only as many as
    fill the cores."""
    subs = max(1, math.ceil(row_bytes / min(SUB_BYTES, group_bytes)))
    groups = max(1, math.ceil(4 * cores / subs))
    right = (rows.withColumn("sub", _by_hash(subs, "probe_id")).groupBy("sub").applyInArrow(_pack_terms, "sub int, blob binary")
             .repartitionById(subs, F.col("sub")).select("sub", F.col("blob").alias("probes")).checkpoint())
    left = (docs.select("bank_id", "tokens", F.lit(0).alias("block")).mapInArrow(_pack_cut, "".join(f"{c} binary, " for c in _parts()) + "last boolean").checkpoint().coalesce(groups)
            .withColumn("first", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0))
    pairs = left.crossJoin(right.hint("shuffle_replicate_nl")).select("sub", F.when(F.col("first"), F.col("probes")).alias("probes"), *_parts(), "last")
    return pairs.mapInArrow(_streamed_body(k, weigh, _arrow(schema), subs), schema), groups


def sparse_topk(probe_terms: DataFrame, bank: DataFrame, k: int, weigh: Weigh, *, probe_ids: DataFrame,
                bank_bytes: int | None = None, probe_bytes: int | None = None, group_bytes: int = GROUP_BYTES, prune_from: int = PRUNE_FROM) -> DataFrame:
    """Top-k bank rows per probe for a score that is a sum over shared terms.

    score(p, d) = sum over terms t of probe_weight(p, t) * weigh(tf(d, t), length(d)).
    ``probe_terms``: (probe_id, term, weight); rows of one (probe, term) add up;
    ``probe_ids``: every probe, so one without a known term gets its (all-zero)
    list; ``bank``: (bank_id, tokens), one row per document, of about
    ``bank_bytes`` in all (counted where it isn't given, as is ``probe_bytes``, that
    of the terms), and optionally
    ``cluster``, whose values are kept in blocks of their own. Documents sharing
    no term score 0 and compete by lowest id; ``weigh`` must not be negative.

    A bank of ``prune_from`` blocks or more is pruned by block maxima where all terms
    of the probes fit a value, which costs a pass over it and a row for each term and
    block. Where there are more probes, every document is scored without a copy of
    either side; the result is the same.
    """
    schema, arrow = _types(probe_ids, bank)
    rows, size = _term_rows(probe_ids, probe_terms), F.coalesce(F.octet_length("term"), F.lit(0)) + 32
    docs = bank.select("bank_id", _tokens_column(), *[c for c in bank.columns if c == "cluster"])
    if bank_bytes is None:
        bank_bytes = docs.agg(F.sum(F.size("tokens") * 10 + 16)).first()[0] or 0
    if probe_bytes is None:
        probe_bytes = rows.agg(F.sum(size)).first()[0] or 0
    cores = bank.sparkSession.sparkContext.defaultParallelism
    at_least = min(cores, math.ceil(bank_bytes / LEAST_BLOCK))
    blocks = max(1, math.ceil(bank_bytes / group_bytes), at_least)
    if blocks < prune_from:
        local, blocks = _packed_cells(rows, probe_bytes, docs, math.ceil(bank_bytes / PACKED), max(1, at_least), group_bytes, _packed_body(k, weigh, arrow), schema)
        return _merge(local, k, blocks)
    if probe_bytes > SUB_BYTES:
        local, groups = _streamed(rows, probe_bytes, docs, max(1, at_least), group_bytes, k, weigh, schema)
        return _merge(local, k, groups)
    tiles = max(1, math.ceil(probe_bytes / group_bytes))
    rows = rows.withColumn("tile", _by_hash(tiles, "probe_id"))
    body = _sparse_body(k, weigh, arrow)
    keyed = _blocks_of(docs, blocks)

    def scored(pairs: DataFrame) -> DataFrame:
        left = rows.join(pairs, "probe_id")
        need = left.select(F.col("tile").alias("to_tile"), F.col("block").alias("to_block")).distinct()
        right = keyed.join(need, keyed["block"] == need["to_block"]).select("bank_id", "tokens", F.col("to_tile").alias("tile"), F.col("to_block").alias("block"))
        return _cells(left, right, tiles * (blocks + (BUCKETS if "cluster" in docs.columns else 0)), body, schema)
    first, rest = open_blocks(rows, keyed, k, weigh, scored)
    return _merge(first.unionByName(scored(rest)), k)
