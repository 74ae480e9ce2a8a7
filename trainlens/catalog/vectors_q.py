"""Registered vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.catalog import sql
from trainlens.catalog.attribution_q import r6
from trainlens.operators import attribution as A
from trainlens.operators import vectors as V
from trainlens.plans.blocked_topk import dense_topk
from trainlens.registry import register
from trainlens.sources.corpus import vector_samples
from trainlens.sources.tables import read_table

N_COORDS = 16
# The named coordinate groups, each a quarter of the width.
TENSORS = ("block0.attn", "block0.mlp", "block1.attn", "block1.mlp")


def _width(spark, sf_dir) -> int:
    return V.vector_width(read_table(spark, sf_dir, "embeddings"), "embedding")


def _coords(spark, sf_dir) -> DataFrame:
    return V.coordinate_sample(spark, _width(spark, sf_dir), N_COORDS, 2026)


@register("coordinate_sample", f"""
SELECT CAST(i AS BIGINT) AS coord FROM (
  SELECT i FROM range(0, (SELECT max(len(embedding)) FROM embeddings)) t(i)
  ORDER BY md5('2026:' || CAST(i AS VARCHAR)), i LIMIT {N_COORDS})""")
def coordinate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 seeded coordinates of the gradient width read from the table."""
    return _coords(spark, sf_dir)


@register("gathered_gradients", f"""
WITH s AS ({sql.vector_samples_sql()}),
c AS (SELECT list(coord ORDER BY coord) AS cs FROM (
  SELECT i AS coord FROM range(0, (SELECT max(len(embedding)) FROM embeddings)) t(i)
  ORDER BY md5('2026:' || CAST(i AS VARCHAR)), i LIMIT {N_COORDS})),
g AS (SELECT idx, split, list_transform(cs, lambda i: coalesce(grad[i + 1], 0.0)) AS sub FROM s, c)
SELECT idx, split, round(sqrt(list_dot_product(sub, sub)), 6) AS sub_norm, round(list_sum(sub), 6) AS sub_sum
FROM g""")
def gathered_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gradient reduced to the sampled coordinates (norm and sum shown)."""
    coords = [r["coord"] for r in _coords(spark, sf_dir).collect()]  # k values, bounded
    s = vector_samples(spark, sf_dir).withColumn("sub", V.gather("grad", coords))
    return s.select("idx", "split", F.round(F.sqrt(F.aggregate(F.transform("sub", lambda x: x * x),
                                                               F.lit(0.0), lambda a, x: a + x)), 6)
                    .alias("sub_norm"),
                    F.round(F.aggregate("sub", F.lit(0.0), lambda a, x: a + x), 6).alias("sub_sum"))


def _offsets_sql() -> str:
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(TENSORS))
    return (f"(SELECT name, i * (w // {len(TENSORS)}) AS start_, (i + 1) * (w // {len(TENSORS)}) AS end_ "
            f"FROM (VALUES {names}) t(i, name), (SELECT max(len(embedding)) AS w FROM embeddings)) o")


@register("dot_share_by_group", f"""
WITH {sql.samples_ctes()},
{sql.cosine_ctes(src="s")},
top AS (SELECT probe_id AS test_idx, bank_id AS train_idx FROM crk WHERE rank <= 5),
pr AS (SELECT top.test_idx, top.train_idx, p.grad AS a, b.grad AS b FROM top
       JOIN s p ON p.idx = top.test_idx JOIN s b ON b.idx = top.train_idx),
ex AS (SELECT test_idx, train_idx, list_dot_product(a, b) AS d, unnest(range(0, len(a))) AS coord,
              unnest(list_transform(range(1, len(a) + 1), lambda i: a[i] * b[i])) AS p FROM pr)
SELECT test_idx, train_idx, coalesce(name, '(unnamed)') AS name,
       round(CASE WHEN any_value(d) <> 0 THEN sum(p) / any_value(d) END, 6) AS share
FROM ex LEFT JOIN {_offsets_sql()} ON coord >= start_ AND coord < end_
GROUP BY test_idx, train_idx, coalesce(name, '(unnamed)')""")
def dot_share_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each gradient-cosine top-5 pair, each named group's share of the dot product."""
    s = vector_samples(spark, sf_dir)
    ts = s.where(F.col("split") == "test")
    tr = s.where(F.col("split") == "train")
    top = A.gradient_cosine_topk(ts, tr, 5).select("test_idx", "train_idx")
    pairs = (top.join(s.select(F.col("idx").alias("test_idx"), F.col("grad").alias("a")), "test_idx")
                .join(s.select(F.col("idx").alias("train_idx"), F.col("grad").alias("b")), "train_idx"))
    out = V.dot_share_by_group(pairs, "a", "b", V.offset_table(spark, [(n, _width(spark, sf_dir) // len(TENSORS)) for n in TENSORS]))
    return out.select("test_idx", "train_idx", "name", r6("share"))


@register("gradient_store_stats", f"""
WITH s AS ({sql.vector_samples_sql()})
SELECT split, count(*) AS rows, max(len(grad)) AS width, CAST(sum(len(grad)) * 4 AS BIGINT) AS bytes,
       round(sum(len(grad)) * 4 / 1048576.0, 6) AS mib, round(avg(loss), 6) AS mean_loss
FROM s GROUP BY split""")
def gradient_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V06 + G08: rows, width, float32 bytes, MiB and mean loss per split."""
    m = V.matrix_stats(vector_samples(spark, sf_dir), "split")
    return m.select("split", "rows", "width", "bytes",
                    F.round(F.col("bytes") / 1048576.0, 6).alias("mib"), r6("mean_loss"))


@register("sample_gradients", f"""
WITH s AS ({sql.vector_samples_sql()})
SELECT idx, split, round(loss, 6) AS loss, round(sqrt(list_dot_product(grad, grad)), 6) AS grad_norm FROM s""")
def sample_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-sample logistic-probe loss and gradient norm."""
    s = vector_samples(spark, sf_dir)
    return s.select("idx", "split", r6("loss"),
                    F.round(F.sqrt(F.aggregate(F.transform("grad", lambda x: x * x), F.lit(0.0),
                                               lambda a, x: a + x)), 6).alias("grad_norm"))


TOP_INF = 50


@register("influence_top50", f"""
WITH s AS ({sql.vector_samples_sql()}),
sc AS (SELECT p.idx AS test_id, b.idx AS train_id, list_dot_product(p.grad, b.grad) AS influence_score
       FROM (SELECT * FROM s WHERE split = 'test') p CROSS JOIN (SELECT * FROM s WHERE split = 'train') b),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(influence_score, 9) DESC, train_id) AS rank
      FROM sc)
SELECT test_id, train_id, round(influence_score, 6) AS influence_score, CAST(rank AS INTEGER) AS rank
FROM r WHERE rank <= {TOP_INF}""")
def influence_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + M12: gradient dot influence over the whole train bank, the top 50
    per test sample, ranked from 1."""
    return influence_top(spark, sf_dir, TOP_INF)


def influence_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    s = vector_samples(spark, sf_dir)
    t = dense_topk(s.where(F.col("split") == "test").select(F.col("idx").alias("probe_id"), F.col("grad").alias("vec")),
                   s.where(F.col("split") == "train").select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec")),
                   k, metric="dot")
    return t.select(F.col("probe_id").alias("test_id"), F.col("bank_id").alias("train_id"),
                    F.round("score", 6).alias("influence_score"), "rank")


@register("influence_topk_lists", f"""
WITH s AS ({sql.vector_samples_sql()}),
sc AS (SELECT p.idx AS test_id, b.idx AS train_id, list_dot_product(p.grad, b.grad) AS score
       FROM (SELECT * FROM s WHERE split = 'test') p CROSS JOIN (SELECT * FROM s WHERE split = 'train') b),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, train_id) AS rank FROM sc)
SELECT test_id, string_agg(CAST(train_id AS VARCHAR), ',' ORDER BY rank) AS topk_train_ids
FROM r WHERE rank <= 5 GROUP BY test_id""")
def influence_topk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test sample, the ordered top-5 list of (rank, train_id, score), shown as ids."""
    m = A.topk_map(influence_top(spark, sf_dir, 5), 5)
    return m.select("test_id", F.concat_ws(",", F.transform("topk", lambda x: x["train_id"].cast("string")))
                    .alias("topk_train_ids"))


@register("ihvp_diag_topk", f"""
WITH s AS ({sql.vector_samples_sql()}),
tr AS (SELECT * FROM s WHERE split = 'train'),
fd AS (SELECT pos, avg(g * g) AS f FROM (SELECT unnest(grad) AS g, unnest(range(0, len(grad))) AS pos FROM tr)
       GROUP BY pos),
pre AS (SELECT list(1.0 / (f + 0.01) ORDER BY pos) AS c FROM fd),
sc AS (SELECT p.idx AS test_id, b.idx AS train_id,
              list_sum(list_transform(range(1, len(p.grad) + 1), lambda i: p.grad[i] * pre.c[i] * b.grad[i])) AS score
       FROM (SELECT * FROM s WHERE split = 'test') p CROSS JOIN tr b CROSS JOIN pre),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, train_id) AS rank FROM sc)
SELECT test_id, train_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def ihvp_diag_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 (diagonal, mode ihvp, damping 0.01): Fisher-preconditioned influence top 5."""
    s = vector_samples(spark, sf_dir)
    t = V.ihvp_diag_topk(s.where(F.col("split") == "test"), s.where(F.col("split") == "train"), 5)
    return t.select(F.col("probe_id").alias("test_id"), F.col("bank_id").alias("train_id"),
                    F.round("score", 6).alias("score"), "rank")


@register("probe_score_profile", f"""
WITH s AS ({sql.vector_samples_sql()}),
sc AS (SELECT p.idx AS test_idx, list_dot_product(p.grad, b.grad) AS score
       FROM (SELECT * FROM s WHERE split = 'test') p CROSS JOIN (SELECT * FROM s WHERE split = 'train') b),
r AS (SELECT *, row_number() OVER (PARTITION BY test_idx ORDER BY round(score, 9) DESC) AS rk FROM sc),
c AS (SELECT test_idx, any_value(score) AS cutoff FROM r WHERE rk = 5 GROUP BY test_idx)
SELECT c.test_idx, round(c.cutoff, 6) AS cutoff, round(avg(sc.score), 6) AS mean_score,
       round(100.0 * sum(CASE WHEN round(sc.score, 9) >= round(c.cutoff, 9) THEN 1 ELSE 0 END) / count(*), 6)
         AS pct_at_or_above
FROM c JOIN sc USING (test_idx) GROUP BY c.test_idx, c.cutoff""")
def probe_score_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test sample, the 5th-largest influence score over the whole
    train bank, the mean score, and the share of rows at or above the cutoff."""
    from trainlens.operators.agreement import probe_score_profile as profile
    s = vector_samples(spark, sf_dir)
    p = profile(s.where(F.col("split") == "test"), s.where(F.col("split") == "train"), 5)
    return p.select("test_idx", r6("cutoff"), r6("mean_score"), r6("pct_at_or_above"))


@register("ihvp_full_topk")
def ihvp_full_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 (full inverse): q^T (G^T G / n + 0.01 I)^-1 b top 5 per test sample;
    the Gram matrix is summed from per-partition partials (d x d on the driver,
    d bounded). No SQL oracle: DuckDB has no matrix inverse."""
    s = vector_samples(spark, sf_dir)
    t = V.ihvp_topk(s.where(F.col("split") == "test"), s.where(F.col("split") == "train"), 5, _width(spark, sf_dir))
    return t.select(F.col("probe_id").alias("test_id"), F.col("bank_id").alias("train_id"),
                    F.round("score", 6).alias("score"), "rank")


RECURSION = V.InfluenceConfig(scale=10.0, recursion_depth=4)


def _recursion_sql(cfg: V.InfluenceConfig) -> str:
    """CTEs h0 .. hN (probe_id, h): the recursion's steps."""
    out = [f"h0 AS (SELECT idx AS probe_id, grad AS q, list_transform(grad, lambda x: x / {cfg.scale}) AS h FROM s WHERE split = 'test')"]
    for t in range(cfg.recursion_depth):
        out.append(f"""f{t} AS (SELECT probe_id, pos, sum(d * g) / (SELECT count(*) FROM tr) AS f FROM (
  SELECT probe_id, list_dot_product(h, grad) AS d, unnest(grad) AS g, unnest(range(0, len(grad))) AS pos FROM h{t} CROSS JOIN tr) GROUP BY ALL),
c{t} AS (SELECT probe_id, list(f ORDER BY pos) AS f FROM f{t} GROUP BY probe_id),
h{t + 1} AS (SELECT h.probe_id, q, list_transform(range(1, len(q) + 1), lambda i: h.h[i] + (q[i] - c.f[i] - {cfg.damping} * h.h[i]) / {cfg.scale}) AS h
  FROM h{t} h JOIN c{t} c USING (probe_id))""")
    return ",\n".join(out)


@register("ihvp_recursive_topk", f"""
WITH s AS ({sql.vector_samples_sql()}),
tr AS (SELECT idx, grad FROM s WHERE split = 'train'),
{_recursion_sql(RECURSION)},
sc AS (SELECT probe_id AS test_id, idx AS train_id, list_dot_product(h, grad) AS score FROM h{RECURSION.recursion_depth} CROSS JOIN tr),
r AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY round(score, 9) DESC, train_id) AS rank FROM sc)
SELECT test_id, train_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def ihvp_recursive_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 (recursion: scale 10, depth 4, one sample): top 5 per test sample."""
    s = vector_samples(spark, sf_dir)
    t = V.ihvp_recursive_topk(s.where(F.col("split") == "test"), s.where(F.col("split") == "train"), 5, _width(spark, sf_dir), RECURSION)
    return t.select(F.col("probe_id").alias("test_id"), F.col("bank_id").alias("train_id"),
                    F.round("score", 6).alias("score"), "rank")
