"""Vector operators (V01-V08) and inverse-Hessian influence.

Per-row algebra is SQL higher-order functions. Cross-row algebra (a Gram
matrix) is computed as per-partition NumPy partial sums that Spark adds up,
so only a d x d matrix (d is bounded, checked) ever reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlens.functions.hashing import seeded_order_key
from trainlens.functions.vector import dot
from trainlens.plans.blocked_topk import GROUP_BYTES, _steps, dense_topk, is_valid_vector

MAX_GRAM_DIM = 4096


def coordinate_sample(spark, total: int, k: int, seed: int = 2026) -> DataFrame:
    """min(k, total) distinct coordinates of range(total), seeded, sorted.
    The range is generated in parallel, as a parameter count may be large."""
    return (spark.range(total).select(F.col("id").alias("coord"))
                 .orderBy(seeded_order_key(seed, "coord"), "coord").limit(k)
                 .orderBy("coord"))


def gather(vec_col, coords: list[int]):
    """The listed coordinates of a vector; coordinates past its end read 0."""
    arr = F.array(*[F.lit(int(c)) for c in coords])
    return F.transform(arr, lambda i: F.coalesce(F.get(vec_col, i), F.lit(0.0)))


def offset_table(spark, tensors: list[tuple[str, int]]) -> DataFrame:
    """(name, start, end) half-open ranges from tensor sizes (running sum)."""
    df = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(tensors)], "pos int, name string, size long")
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("end", F.sum("size").over(w))
              .withColumn("start", F.col("end") - F.col("size")).select("name", "start", "end"))


def dot_share_by_group(pairs: DataFrame, a: str, b: str, offsets: DataFrame) -> DataFrame:
    """V03 (re-aimed): share of each named coordinate group in a dot product.

    pairs: rows holding vectors ``a`` and ``b`` plus their keys. The
    per-coordinate products are exploded and joined on the coordinate to the
    offset table expanded to one row per coordinate; coordinates outside every
    group are the group ``(unnamed)``, so shares sum to 1 at any width.
    """
    keys = [c for c in pairs.columns if c not in (a, b)]
    prod = pairs.select(*keys, dot(a, b).alias("_dot"),
                        F.posexplode(F.zip_with(a, b, lambda x, y: x * y)).alias("coord", "p"))
    # one row per coordinate (bounded by the vector width): the range lookup
    # becomes an equi-join instead of a nested-loop range join
    lookup = offsets.select("name", F.explode(F.sequence("start", F.col("end") - 1)).alias("coord"))
    j = prod.join(lookup, "coord", "left").withColumn("name", F.coalesce("name", F.lit("(unnamed)")))
    return (j.groupBy(*keys, "name").agg(F.sum("p").alias("part"), F.first("_dot").alias("_dot"))
             .withColumn("share", F.when(F.col("_dot") != 0, F.col("part") / F.col("_dot")))
             .drop("_dot"))


def matrix_stats(df: DataFrame, group: str, vec_col: str = "grad", loss_col: str = "loss") -> DataFrame:
    """Rows, width, float32 bytes and mean loss per group."""
    return (df.groupBy(group)
              .agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vec_col)).cast("long").alias("width"),
                   (F.sum(F.size(vec_col)) * 4).cast("long").alias("bytes"),
                   F.avg(loss_col).alias("mean_loss")))


def gradients_with(df: DataFrame, fn, out_dim: int) -> DataFrame:
    """V07 hook: a user function ``fn(pandas.DataFrame) -> (grads ndarray n x d,
    losses ndarray n)`` applied batch-wise with mapInPandas."""
    from pyspark.sql import types as T
    schema = (T.StructType(list(df.schema.fields))
              .add("grad", T.ArrayType(T.DoubleType())).add("loss", T.DoubleType()))

    def run(batches):
        for pdf in batches:
            g, loss = fn(pdf)
            pdf = pdf.copy()
            pdf["grad"] = list(np.asarray(g, dtype=np.float64).reshape(len(pdf), out_dim))
            pdf["loss"] = np.asarray(loss, dtype=np.float64)
            yield pdf
    return df.mapInPandas(run, schema)


# ---------------------------------------------------------------- M13
@dataclass(frozen=True)
class InfluenceConfig:
    """The defaults. ``scale`` bounds the curvature's largest
    eigenvalue, ``recursion_depth`` is the number of steps of the recursion,
    ``num_samples`` the number of parts of the bank whose results are averaged."""
    mode: str = "ihvp"
    damping: float = 0.01
    scale: float = 25.0
    recursion_depth: int = 256
    num_samples: int = 1

    def validate(self) -> None:
        if self.mode != "ihvp":
            raise ValueError(f"unsupported influence mode {self.mode!r}; only 'ihvp' is available")
        if self.damping < 0 or self.scale <= 0 or self.recursion_depth < 0 or self.num_samples < 1:
            raise ValueError("damping and recursion_depth must not be negative, scale and num_samples must be positive")


def _stack(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    c = batch.column(0)
    if (c.value_lengths().to_numpy(zero_copy_only=False) != dim).any():
        raise ValueError(f"gradients differ from width {dim}")
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def vector_width(df: DataFrame, vec_col: str = "grad") -> int:
    """Width of the vectors that take part (0 if there are none)."""
    return df.where(is_valid_vector(vec_col)).agg(F.max(F.size(vec_col))).first()[0] or 0


def fisher_diagonal(bank: DataFrame, dim: int, vec_col: str = "grad") -> DataFrame:
    """(coord, mean g^2): diagonal of the empirical Fisher, one row per
    coordinate, from one partial sum per partition."""
    def partial(batches):
        total, n = np.zeros(dim), 0
        for b in batches:
            m = _stack(b, dim)
            total += (m * m).sum(0)
            n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, n))], ["coord", "total", "n"])
    parts = bank.where(is_valid_vector(vec_col)).select(vec_col).mapInArrow(partial, "coord long, total double, n long")
    return parts.groupBy("coord").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("fisher"))


def ihvp_diag_topk(probes: DataFrame, bank: DataFrame, k: int,
                   cfg: InfluenceConfig = InfluenceConfig()) -> DataFrame:
    """M13 (diagonal): score = sum_i q_i b_i / (mean_train g_i^2 + damping).

    The preconditioner has one value per coordinate; as one array it is folded
    into the probe vectors before the dot product.
    """
    cfg.validate()
    fisher = fisher_diagonal(bank, vector_width(bank))
    pre = fisher.agg(F.transform(F.array_sort(F.collect_list(F.struct("coord", "fisher"))),
                                 lambda x: 1.0 / (x["fisher"] + F.lit(cfg.damping)))).scalar()
    p = (probes.withColumn("_pre", pre)
               .select(F.col("idx").alias("probe_id"), F.zip_with("grad", "_pre", lambda g, c: g * c).alias("vec")))
    b = bank.select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec"))
    return dense_topk(p, b, k, metric="dot")


ROWS = 64  # matrix rows per packed block


def gram_matrix(bank: DataFrame, dim: int) -> tuple[np.ndarray, int]:
    """Empirical Fisher G^T G and the number of gradients.

    A partition's partial sum leaves as packed blocks of ``ROWS`` matrix rows;
    blocks are added up in two levels, so no task gets one from every
    partition. What comes to the driver is the d x d matrix, whose width is
    checked before any work.
    """
    if dim > MAX_GRAM_DIM:
        raise ValueError(f"dimension {dim} exceeds {MAX_GRAM_DIM}")
    if not dim:
        return np.zeros((0, 0)), 0
    blocks = range(0, dim, ROWS)

    def partial(batches):
        g, n = np.zeros((dim, dim)), 0
        for b in batches:
            m = _stack(b, dim)
            g += m.T @ m
            n += len(m)
        src = TaskContext.get().partitionId() % 32
        yield pa.RecordBatch.from_arrays(
            [pa.array([i // ROWS for i in blocks], pa.int32()), pa.array([src] * len(blocks), pa.int32()),
             pa.array([g[i:i + ROWS].tobytes() for i in blocks], pa.binary()), pa.array([n] * len(blocks), pa.int64())], ["block", "src", "cells", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t.column("cells"))
        first = t.slice(0, 1)
        return pa.table({"block": first.column("block"), "src": first.column("src"), "cells": pa.array([total.tobytes()], pa.binary()),
                         "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64())})
    schema = "block int, src int, cells binary, n long"
    parts = bank.where(is_valid_vector("grad")).select("grad").mapInArrow(partial, schema)
    rows = parts.groupBy("block", "src").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).orderBy("block").toArrow()
    if not len(rows):
        return np.zeros((dim, dim)), 0
    cells = np.concatenate([np.frombuffer(x.as_py()) for x in rows.column("cells")])
    return cells.reshape(dim, dim), rows.column("n")[0].as_py()


def ihvp_topk(probes: DataFrame, bank: DataFrame, k: int, dim: int,
              cfg: InfluenceConfig = InfluenceConfig()) -> DataFrame:
    """M13 (full): score = q^T (F + damping I)^-1 b with F = G^T G / n.

    The damped inverse is d x d (d is bounded, see ``gram_matrix``); it is
    broadcast and applied to the probes batch-wise, then the dot product ranks
    the bank.
    """
    cfg.validate()
    gram, n = gram_matrix(bank, dim)
    inv = np.linalg.inv(gram / max(n, 1) + cfg.damping * np.eye(dim))
    bc = probes.sparkSession.sparkContext.broadcast(inv)

    def apply(batches):
        for b in batches:
            q = _stack(b.select(["grad"]), dim) @ bc.value.T
            off = pa.array(np.arange(0, q.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(off, pa.array(q.ravel()))], ["probe_id", "vec"])
    p = probes.where(is_valid_vector("grad")).select("idx", "grad")
    p = p.mapInArrow(apply, f"probe_id {p.schema['idx'].dataType.simpleString()}, vec array<double>")
    b = bank.select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec"))
    return dense_topk(p, b, k, metric="dot")


# ---- matrix-free: no d x d matrix, any width
_ADD = "sample int, tile int, src int, cells binary, n long"


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, dim)


def _pack(by: list[str], dim: int):
    """One row per group: the ids and the matrix of its vectors, in id order."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("idx", "ascending")])
        vecs = pa.concat_arrays(t.column("grad").chunks)
        if (vecs.value_lengths().to_numpy() != dim).any():
            raise ValueError(f"gradients differ from width {dim}")
        flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        ids = pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.concat_arrays(t.column("idx").chunks))
        return pa.table({**{c: t.column(c).slice(0, 1) for c in by}, "ids": ids, "cells": pa.array([flat.tobytes()], pa.binary())})
    return run


def _factor(g: np.ndarray) -> np.ndarray:
    """A matrix of no more rows than columns with the same sum of g g^T over its rows."""
    return np.ascontiguousarray(np.linalg.qr(g, mode="r")) if len(g) > g.shape[1] > 0 else g


def _pack_block(dim: int):
    """One row per group: what its vectors add to the curvature, and how many they are."""
    pack = _pack(["sample", "block"], dim)

    def run(t: pa.Table) -> pa.Table:
        row = pack(t)
        return pa.table({"sample": row.column("sample"), "block": row.column("block"), "n": pa.array([len(t)], pa.int64()),
                         "cells": pa.array([_factor(_matrix(row.column("cells")[0].as_py(), dim)).tobytes()], pa.binary())})
    return run


def _fold(dim: int):
    """Blocks as one."""
    def run(t: pa.Table) -> pa.Table:
        whole = _factor(np.concatenate([_matrix(x.as_py(), dim) for x in t.column("cells")]))
        return pa.table({"sample": t.column("sample")[:1], "block": t.column("block")[:1], "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64()),
                         "cells": pa.array([whole.tobytes()], pa.binary())})
    return run


def _curvature(dim: int):
    """A block's part of the sum of g (g . h), for every vector h of a tile; some
    products g . h at a time."""
    def run(key: tuple[pa.Scalar, ...], block: pa.Table, tiles: pa.Table) -> pa.Table:
        sample, number, tile = (x.as_py() for x in key)
        rows = []
        for raw, n in zip(block.column("cells"), block.column("n").to_pylist(), strict=True):
            g = _matrix(raw.as_py(), dim)
            for x in tiles.column("h"):
                h = _matrix(x.as_py(), dim)
                out = np.empty_like(h)
                for s in _steps(len(g), len(h)):
                    out[s] = (h[s] @ g.T) @ g
                rows.append((sample, tile, number % 32, out.tobytes(), n))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)],
                        names=["sample", "tile", "src", "cells", "n"])
    return run


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in t.column("cells").to_pylist())
    return pa.table({"sample": t.column("sample")[:1], "tile": t.column("tile")[:1], "src": t.column("src")[:1],
                     "cells": pa.array([total.tobytes()], pa.binary()), "n": pa.array([pc.sum(t.column("n")).as_py()], pa.int64())})


def _step(damping: float, scale: float):
    def run(batches):
        for b in batches:
            q, h, f, n = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("q", "h", "cells", "n"))
            out = []
            for i in range(b.num_rows):
                v = np.frombuffer(h[i])
                curved = np.frombuffer(f[i]) / n[i] if n[i] else 0.0
                out.append((v + (np.frombuffer(q[i]) - curved - damping * v) / scale).tobytes())
            at = b.schema.get_field_index("h")
            cols = [pa.array(out, pa.binary()) if i == at else b.column(i) for i in range(at + 1)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:at + 1])
    return run


def ihvp_vectors(probes: DataFrame, bank: DataFrame, dim: int, cfg: InfluenceConfig = InfluenceConfig(), *,
                 group_bytes: int = GROUP_BYTES) -> DataFrame:
    """M13 (recursion): (probe_id, vec), an approximation of (F + damping I)^-1 q
    for every probe gradient q, F being the mean of g g^T over the bank.

    h_0 = q / scale, h_t+1 = h_t + (q - F h_t - damping h_t) / scale, for
    ``recursion_depth`` steps; it converges where ``scale`` is at least the
    largest eigenvalue of F plus the damping, by a factor of
    1 - (smallest eigenvalue + damping) / scale a step. With ``num_samples`` over
    one, the bank is dealt into that many parts, each gives its own recursion
    and the results are averaged.

    Probes are packed into tiles and the bank into blocks of a quarter of
    ``group_bytes``, once. A block of more vectors than they are wide is kept as its
    triangular factor, which is smaller and has the same g (g . h); blocks so made
    small are put together. No other matrix of d x d exists. A step sends the tiles
    to the blocks, one of each to a cell, adds up what comes back in two levels, and
    writes the tiles' new state to the checkpoint folder, so a lost executor costs
    one step's tasks and the plan does not grow.
    """
    cfg.validate()
    spark = probes.sparkSession
    p = probes.where(is_valid_vector("grad")).select("idx", "grad")
    b = bank.where(is_valid_vector("grad")).select("idx", "grad")
    kind = p.schema["idx"].dataType.simpleString()
    row = max(1, dim * 8)
    piece = max(1, group_bytes // 4)  # a cell holds several copies of a piece
    pieces = lambda df: max(1, math.ceil(df.count() * row / piece))
    tiles, blocks = pieces(p), pieces(b)
    blocks = max(blocks, min(spark.sparkContext.defaultParallelism, blocks * piece // (1 << 20) if blocks > 1 else 1))
    by_hash = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "idx", "grad"), F.lit(n)).cast("int")
    kept = "sample int, block int, n long, cells binary"
    packed = (b.withColumn("sample", by_hash(cfg.num_samples, 5)).withColumn("block", by_hash(blocks, 6))
              .groupBy("sample", "block").applyInArrow(_pack_block(dim), kept).checkpoint())
    total = packed.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
    fewer = max(1, math.ceil(total / cfg.num_samples / piece))
    if fewer < blocks:
        packed, blocks = packed.withColumn("block", F.pmod("block", F.lit(fewer))).groupBy("sample", "block").applyInArrow(_fold(dim), kept).checkpoint(), fewer
    start = (p.withColumn("tile", by_hash(tiles, 7)).groupBy("tile").applyInArrow(_pack(["tile"], dim), f"tile int, ids array<{kind}>, cells binary")
             .withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(cfg.num_samples - 1)))))

    def scaled(batches):
        for x in batches:
            h = [(np.frombuffer(q) / cfg.scale).tobytes() for q in x.column(x.schema.get_field_index("q")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(h, pa.binary())], [*x.schema.names, "h"])
    shape = f"sample int, tile int, ids array<{kind}>, q binary, h binary"
    state = start.select("sample", "tile", "ids", F.col("cells").alias("q")).mapInArrow(scaled, shape).checkpoint()
    cell, n = ["sample", "block", "tile"], min(4 * blocks * tiles * cfg.num_samples, 100_000)
    packed = packed.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    for _ in range(cfg.recursion_depth):
        sent = state.select(F.col("sample").alias("sample"), F.col("tile").alias("tile"), F.col("h").alias("h"),
                            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        parts = (packed.repartition(n, *cell).groupBy(*cell).cogroup(sent.repartition(n, *cell).groupBy(*cell))
                 .applyInArrow(_curvature(dim), _ADD))
        whole = parts.groupBy("sample", "tile", "src").applyInArrow(_add, _ADD).groupBy("sample", "tile").applyInArrow(_add, _ADD)
        state = (state.join(whole.select("sample", "tile", "cells", "n"), ["sample", "tile"], "left")
                 .withColumn("cells", F.coalesce("cells", F.lit(b"").cast("binary"))).withColumn("n", F.coalesce("n", F.lit(0)))
                 .mapInArrow(_step(cfg.damping, cfg.scale), shape).checkpoint())

    def mean(t: pa.Table) -> pa.Table:
        h = sum(_matrix(x, dim) for x in t.column("h").to_pylist()) / len(t)
        ids = t.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        off = pa.array(np.arange(0, h.size + 1, dim, dtype=np.int32))
        return pa.table({"probe_id": ids.slice(0, 1).flatten(), "vec": pa.ListArray.from_arrays(off, pa.array(h.ravel()))})
    return state.groupBy("tile").applyInArrow(mean, f"probe_id {kind}, vec array<double>")


def ihvp_recursive_topk(probes: DataFrame, bank: DataFrame, k: int, dim: int,
                        cfg: InfluenceConfig = InfluenceConfig(), *, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """M13 (recursion): the k best bank rows per probe by ``ihvp_vectors``."""
    p = ihvp_vectors(probes, bank, dim, cfg, group_bytes=group_bytes)
    return dense_topk(p, bank.select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec")), k, metric="dot")
