"""Exact top-k search as a Voronoi kNN join.

Score is the inner product of integer vectors. With M the largest norm, a
vector v becomes (v, sqrt(M^2 - |v|^2)) and a query q becomes (q, 0): the
squared distance of the two is |q|^2 + M^2 - 2 q.v, so the nearest neighbours
in that space are the highest scores.

1. Pivots (a bounded sample) cut data and queries into cells by the nearest
   pivot. Every cell reports a summary: size, radius, and the distances of its
   k + 1 members nearest to the pivot. Summaries grow with the number of pivots
   only and are what the driver gets.
2. For a cell of queries, the summaries bound the distance of any of its
   queries' k-th neighbour from above. A data vector whose distance to every
   query of the cell is above that bound by the triangle inequality is not
   sent to it; all others are, which keeps the answer exact.
3. Data of a query cell comes in blocks of bounded size, so a cell that
   attracts much data is many groups. A group solves its block exactly in
   integers; a query's blocks are merged by rank.

Equal vectors travel as one, with their k + 1 smallest ids: ties go to smaller
ids and a query excludes itself only, so no other copy can be in a result.

Defined results: vectors that are null, hold a null or a non-finite component,
or have a null id take no part; all vectors that do must have one width, else
this raises; repeated rows (same id and vector) are one candidate and one
query; a query with fewer than k others gets all of them; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlens.llm import common as C

K, PIVOTS, SCALE = 20, 64, 64


def _matrix(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def clean(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and the integer vector of every row that takes part."""
    v = F.col(f"`{vec_col}`")
    ok = (F.col(f"`{id_col}`").isNotNull() & v.isNotNull()
          & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return (vectors.where(F.coalesce(ok, F.lit(False)))
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """The added coordinate of data vectors."""
    return np.sqrt(np.maximum(top - (x * x).sum(1), 0))


def _distances(x: np.ndarray, lift: np.ndarray | float, pivots: np.ndarray, pivot_lift: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d + (np.asarray(lift).reshape(-1, 1) - pivot_lift[None, :]) ** 2, 0))


def _assign(pivots: np.ndarray, pivot_lift: np.ndarray, top: float, width: int, lifted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(b.schema.get_field_index("v")), width)
            d = _distances(x, _lift(x, top) if lifted else 0.0, pivots, pivot_lift)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell])],
                                             [*b.schema.names, "cell", "dist"])
    return run


def _targets(pivots: np.ndarray, pivot_lift: np.ndarray, top: float, width: int, radius: np.ndarray, bound: np.ndarray):
    """Sends a data vector to the query cells it may matter to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(b.schema.get_field_index("v")), width)
            d = _distances(x, _lift(x, top), pivots, pivot_lift)
            # a query q of cell i has |q - v| >= |v - p_i| - radius_i; the
            # slack covers rounding of distances
            near = (d - radius[None, :] <= bound[None, :] * (1 + 1e-9) + 1e-6) & (radius >= 0)[None, :]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(near.sum(1))).astype(np.int32)),
                                             pa.array(np.nonzero(near)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("ids", "v")] + [lists], ["ids", "v", "cells"])
    return run


def _solve(width: int, k: int, step: int = 256):
    def run(q: pa.Table, s: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(s):
            x, y = _matrix(s.column("v"), width), _matrix(q.column("v"), width)
            ids = s.column("ids").combine_chunks()
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            owner = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())
            flat = ids.flatten().to_numpy()
            mine = q.column("vec_id").to_numpy()
            least = ids.to_pylist()
            least = np.array([i[0] for i in least])
            for a in range(0, len(y), step):
                score = y[a:a + step] @ x.T  # integers under 2**53, so exact
                for i, row in enumerate(score):
                    # the k + 1 best vectors with all ties of the last, then ids
                    if len(row) > k + 1:
                        cut = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                        at = np.flatnonzero(row >= cut)
                        at = at[np.lexsort((least[at], -row[at]))][:k + 1]
                        chosen = np.zeros(len(row), bool)
                        chosen[at] = True
                        c = np.flatnonzero(chosen[owner])
                    else:
                        c = np.arange(len(flat))
                    c = c[flat[c] != mine[a + i]]
                    c = c[np.lexsort((flat[c], -row[owner[c]]))][:k]
                    out.append((np.full(len(c), mine[a + i]), flat[c], row[owner[c]].astype(np.int64)))
        cat = [np.concatenate(z) for z in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(z) for z in cat), strict=True)))
    return run


def topk(vectors: DataFrame, queries: DataFrame, *, k: int = K, pivots: int = PIVOTS, block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best; both inputs
    come from ``clean``."""
    spark = vectors.sparkSession
    C.prepare(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shape = vectors.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"),
                        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("top")).first()
    if shape["least"] is None:
        return empty
    width, top = shape["most"], float(shape["top"])
    if shape["least"] != width or queries.where(F.size("v") != width).limit(1).count():
        raise ValueError("vectors differ in width")
    if top * 4 > 2.0**53:
        raise ValueError("components are too large for exact sums")
    # equal vectors as one row with their smallest ids; the rank is cut before
    # the shuffle as well, so a vector with many copies sends few rows
    w = Window.partitionBy("v").orderBy("vec_id")
    distinct = (vectors.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
                .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).checkpoint())
    sample = distinct.orderBy(F.xxhash64("ids", "v"), "ids").limit(pivots).select("v").collect()
    p = np.array([r["v"] for r in sample], np.float64).reshape(-1, width)
    pl = _lift(p, top)
    cells = distinct.mapInArrow(_assign(p, pl, top, width, True), "v array<bigint>, ids array<bigint>, cell int, dist double")
    near = Window.partitionBy("cell").orderBy("dist")
    nearest = (cells.select("cell", "dist", F.explode("ids")).select("cell", "dist").withColumn("n", F.row_number().over(near))
               .where(F.col("n") <= k + 1).select("cell", "dist").collect())  # pivots * (k + 1) numbers at most
    asked = (queries.dropDuplicates(["vec_id", "v"])
             .mapInArrow(_assign(p, pl, top, width, False), "vec_id bigint, v array<bigint>, cell int, dist double").checkpoint())
    radius = np.full(len(p), -1.0)
    for r in asked.groupBy("cell").agg(F.max("dist").alias("radius")).collect():
        radius[r["cell"]] = r["radius"]
    # k + 1 candidates (one may be the query itself) lie within this of any
    # query of cell i: its radius + pivot distance + their distance to a pivot
    gaps = np.sqrt(np.maximum(((p[:, None] - p[None]) ** 2).sum(2) + (pl[:, None] - pl[None]) ** 2, 0))
    bound = np.full(len(p), np.inf)
    if len(nearest) > k:
        cell, dist = np.array([r["cell"] for r in nearest]), np.array([r["dist"] for r in nearest])
        for i in np.flatnonzero(radius >= 0):
            bound[i] = np.partition(radius[i] + gaps[i, cell] + dist, k)[k]
    sent = (distinct.mapInArrow(_targets(p, pl, top, width, radius, bound), "ids array<bigint>, v array<bigint>, cells array<int>")
            .select("ids", "v", F.explode("cells").alias("cell")))
    sizes = sent.groupBy("cell").count()
    blocks = {r["cell"]: max(1, -(-r["count"] // block)) for r in sizes.collect()}  # one row per pivot
    if not blocks:
        return empty
    many = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    sent = sent.withColumn("part", F.pmod(F.xxhash64("ids"), F.element_at(many, F.col("cell"))).cast("int"))
    # queries of a cell meet every block of it, in batches of bounded size
    counts = {r["cell"]: max(1, -(-r["count"] // 4096)) for r in asked.groupBy("cell").count().collect()}
    batch = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    asked = (asked.withColumn("batch", F.pmod(F.xxhash64("vec_id"), F.element_at(batch, F.col("cell"))).cast("int"))
             .where(F.col("cell").isin(list(blocks)))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.element_at(many, F.col("cell")) - 1))))
    sent = sent.where(F.col("cell").isin(list(counts))).withColumn("batch", F.explode(F.sequence(F.lit(0), F.element_at(batch, F.col("cell")) - 1)))
    key = ["cell", "part", "batch"]
    best = asked.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_solve(width, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
