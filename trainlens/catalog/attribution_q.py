"""Registered attribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.catalog import sql
from trainlens.operators import attribution as A
from trainlens.operators.lexical import bm25_index, bm25_topk
from trainlens.registry import register
from trainlens.sources.corpus import bank_texts, lexical_probes, probe_texts, text_bank, text_probes, vector_samples
from trainlens.sources.tables import read_table

CFG = A.AttributionConfig()


def r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def _split(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def attach_train_metadata(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Add the train row's source after top-k (k rows per probe, small side)."""
    meta = docs.select(F.col("doc_id").alias("train_idx"), F.col("source").alias("train_source"))
    return ranked.join(meta, "train_idx", "left")


# ---------------------------------------------------------------- M09 + J07
def gradient_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vector_samples(spark, sf_dir).select("idx", "split", "grad")
    r = A.gradient_cosine_topk(_split(s, "test"), _split(s, "train"), CFG.top_k)
    r = attach_train_metadata(r, read_table(spark, sf_dir, "documents"))
    return r.select("test_idx", "method", "rank", "train_idx", r6("score"), "train_source")


GRADIENT_COSINE_SQL = f"""
WITH {sql.samples_ctes()},
sc AS (SELECT p.idx AS test_idx, b.idx AS train_idx, {sql.cosine('p.grad', 'b.grad')} AS score
       FROM (SELECT idx, grad FROM s WHERE split = 'test') p
       CROSS JOIN (SELECT idx, grad FROM s WHERE split = 'train') b),
r AS (SELECT *, row_number() OVER (PARTITION BY test_idx ORDER BY round(score, 9) DESC, train_idx) AS rank
      FROM sc)
SELECT r.test_idx, 'gradient_cosine' AS method, CAST(r.rank AS INTEGER) AS rank, r.train_idx,
       round(r.score, 6) AS score, d.source AS train_source
FROM r LEFT JOIN documents d ON d.doc_id = r.train_idx
WHERE r.rank <= {CFG.top_k}
"""
register("gradient_cosine_topk", GRADIENT_COSINE_SQL)(gradient_cosine)


# ---------------------------------------------------------------- M01-M04
@register("bm25_benchmark_topk", f"""
WITH probes AS (SELECT item_id AS probe_id, text FROM benchmark),
docs AS (SELECT doc_id AS bank_id, text FROM documents),
{sql.bm25_ctes('probes', 'docs', CFG.shortlist_n)}
SELECT probe_id, bank_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm25
""")
def bm25_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against the whole document corpus, top 30 by BM25."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bank_id"), "text", F.col("lang").alias("cluster"))
    r = bm25_topk(lexical_probes(spark, sf_dir), docs, CFG.shortlist_n)
    return r.select("probe_id", "bank_id", r6("score"), "rank")


@register("bm25_idf", f"""
WITH docs AS (SELECT doc_id AS bank_id, text FROM documents),
{sql.idf_ctes('docs')}
SELECT term, df, round(idf, 6) AS idf FROM idf JOIN dfs USING (term)
""")
def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency and floored idf of every corpus term."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("bank_id"), "text")
    idx = bm25_index(docs)
    return idx.idf.select("term", "df", r6("idf"))


# ---------------------------------------------------------------- M05-M08, M10
def _text_split(spark, sf_dir):
    return text_probes(spark, sf_dir), text_bank(spark, sf_dir)


def shortlist(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    """The BM25 shortlist of a split's documents, from ids and texts alone."""
    return A.bm25_shortlist(probe_texts(spark, sf_dir, split), bank_texts(spark, sf_dir), CFG)


_HYBRID_DEBUG_SQL = f"""
WITH {sql.sample_bm25()},
{sql.hybrid_ctes()}"""


@register("hybrid_debug", _HYBRID_DEBUG_SQL + """
SELECT probe_id AS test_idx, bank_id AS train_idx, round(bm25_score, 5) AS bm25_score,
       round(semantic_score, 6) AS semantic_score, round(bm25_norm, 6) AS bm25_norm,
       round(semantic_norm, 6) AS semantic_norm, round(hybrid_score, 6) AS hybrid_score,
       CAST(rank AS INTEGER) AS rank
FROM rk""")
def hybrid_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shortlisted row with raw, normalized and blended scores."""
    probes, bank = _text_split(spark, sf_dir)
    d = A.hybrid_debug(probes, bank, CFG, shortlist(spark, sf_dir))
    # raw scores of long probes reach thousands: one digit less, so that the two
    # engines' summation orders cannot round apart
    return d.select("test_idx", "train_idx", F.round("bm25_score", 5).alias("bm25_score"), r6("semantic_score"),
                    r6("bm25_norm"), r6("semantic_norm"), r6("hybrid_score"), "rank")


@register("hybrid_topk", _HYBRID_DEBUG_SQL + f"""
SELECT probe_id AS test_idx, 'hybrid' AS method, CAST(rank AS INTEGER) AS rank, bank_id AS train_idx,
       round(hybrid_score, 6) AS score
FROM rk WHERE rank <= {CFG.top_k}""")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 shortlist of 30, semantic rerank, top 5 per test sample."""
    probes, bank = _text_split(spark, sf_dir)
    r = A.hybrid_topk(probes, bank, CFG, shortlist(spark, sf_dir))
    return r.select("test_idx", "method", "rank", "train_idx", r6("score"))


_INFLUENCE_SQL = f"""
WITH {sql.sample_bm25()},
{sql.influence_ctes()}"""


@register("influence_topk", _INFLUENCE_SQL + f"""
SELECT probe_id AS test_idx, 'influence' AS method, CAST(rank AS INTEGER) AS rank, bank_id AS train_idx,
       round(score, 6) AS score
FROM irk WHERE rank <= {CFG.top_k}""")
def influence_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient dot product on the BM25 shortlist, top 5 per test sample."""
    probes, bank = _text_split(spark, sf_dir)
    r = A.influence_shortlist_topk(probes, bank, CFG, shortlist(spark, sf_dir))
    return r.select("test_idx", "method", "rank", "train_idx", r6("score"))
