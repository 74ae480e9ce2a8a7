"""Lexical retrieval: tokens, BM25 corpus statistics, BM25 top-n per probe.

Texts are split in the JVM. One pass counts, per term, the documents that hold
it; a second pass scores blocks of documents against tiles of the probes'
weights (``plans/blocked_topk.py``). Scoring never joins probe terms to postings
as rows, and nothing but the table of terms is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlens.functions.text import word_tokens
from trainlens.plans.blocked_topk import GROUP_BYTES, sparse_topk, term_counts


@dataclass(frozen=True)
class Bm25Params:
    """Okapi BM25 with negative idf floored at epsilon * mean idf."""
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass
class Bm25Index:
    """Corpus statistics over a bank of documents (bank_id, text)."""
    docs: DataFrame
    idf: DataFrame           # (term, df, idf)
    n_docs: int
    avgdl: float
    mean_idf: float
    params: Bm25Params

    def weigh(self):
        """The saturated, length-normalized part of a term's weight."""
        k1, b, avgdl = self.params.k1, self.params.b, self.avgdl
        return lambda tf, dl: tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * dl / avgdl))


def tokenize(df: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Lower-case whitespace tokens as an array column."""
    return df.withColumn(out, word_tokens(text_col))


def _tokens(c: str = "text"):
    return F.coalesce(word_tokens(c), F.array().cast("array<string>"))


def bm25_index(docs: DataFrame, params: Bm25Params = Bm25Params()) -> Bm25Index:
    """Document frequencies and idf for (bank_id, text).

    Document frequency is a partial count per term, so a term present in
    every document costs one row per map task before the shuffle. The null
    term counts the documents and their tokens in the same pass. The table of
    terms is written once; the numbers read from it are three scalars.
    """
    tokens = docs.select(_tokens().alias("t"))
    terms = (tokens.select(F.size("t").alias("dl"), F.explode(F.concat(F.array_distinct("t"), F.array(F.lit(None).cast("string")))).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("tokens"))
             .checkpoint())
    whole = terms.where("term IS NULL").first()
    n_docs, total = (int(whole["df"]), float(whole["tokens"])) if whole else (0, 0.0)
    raw = terms.where("term IS NOT NULL").withColumn("raw_idf", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean_idf = float(raw.agg(F.avg("raw_idf")).first()[0] or 0.0)
    idf = raw.select("term", "df", F.when(F.col("raw_idf") < 0, F.lit(params.epsilon * mean_idf)).otherwise(F.col("raw_idf")).alias("idf"))
    return Bm25Index(docs, idf, n_docs, total / n_docs if total else 1.0, mean_idf, params)


def probe_term_weights(probes: DataFrame, index: Bm25Index) -> DataFrame:
    """(probe_id, term, weight = query count x idf); repeated query terms add up. Terms
    are counted row by row, so a repeated probe has rows that add up."""
    qt = term_counts(probes.select("probe_id", _tokens().alias("tokens")))
    return (qt.join(index.idf.select("term", "idf"), "term")
              .select("probe_id", "term", (F.col("count") * F.col("idf")).alias("weight")))


def bm25_topk(probes: DataFrame, docs: DataFrame, k: int,
              params: Bm25Params = Bm25Params(), index: Bm25Index | None = None,
              group_bytes: int = GROUP_BYTES) -> DataFrame:
    """M03 + M04: BM25 score of every bank document, top k per probe.

    probes: (probe_id, text); docs: (bank_id, text), optionally ``cluster`` (for
    example the language), by which a large bank is cut into blocks of documents
    with common terms. Rows that share no term
    with the probe score 0 and fill the list by lowest id, as a full sort of
    the score vector would. Returns (probe_id, bank_id, score, rank).
    """
    index = index or bm25_index(docs, params)
    # counted from the texts, so that the terms are not joined twice; unknown terms count too
    size = lambda t: F.aggregate(F.array_distinct(t), F.lit(32), lambda a, x: a + F.octet_length(x) + F.lit(32))
    probe_bytes = probes.agg(F.sum(size(_tokens()).cast("long"))).first()[0] or 0
    return sparse_topk(probe_term_weights(probes, index), docs.select("bank_id", _tokens().alias("tokens"), *[c for c in docs.columns if c == "cluster"]), k, index.weigh(),
                       probe_ids=probes.select("probe_id"), bank_bytes=int(10 * index.avgdl * index.n_docs) + 16 * index.n_docs,
                       probe_bytes=probe_bytes, group_bytes=group_bytes)
