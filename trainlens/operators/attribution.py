"""Attribution methods: rank training rows for every probe at once.

* hybrid retrieval (M04-M08): BM25 shortlist, semantic cosine on the
  shortlist only, per-probe min-max, alpha blend, top k;
* gradient cosine (M09) over the whole bank;
* influence proxy (M10): raw gradient dot on the BM25 shortlist;
* full influence matrix (M11) and per-probe top-k maps (M12);
* merge and summaries (M14, M15) and the ad-hoc case study (M16).

Inputs are DataFrames keyed by ``idx``; every method returns the flat
attribution row (test_idx, method, rank, train_idx, score).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlens.functions.vector import dot, l2_normalize
from trainlens.operators.lexical import Bm25Index, Bm25Params, bm25_index, bm25_topk
from trainlens.plans.blocked_topk import SCORE_DECIMALS, dense_scores, dense_topk
from trainlens.plans.ordinal import prefix_sums

HYBRID = "hybrid"
COSINE = "gradient_cosine"
INFLUENCE = "influence"
METHODS = (HYBRID, COSINE, INFLUENCE)


# Top k 5, BM25 shortlist 30, BM25 weight alpha 0.5.
@dataclass(frozen=True)
class AttributionConfig:
    top_k: int = 5
    shortlist_n: int = 30
    alpha: float = 0.5
    bm25: Bm25Params = Bm25Params()


def _rank_window(part: str, score: str, tie: str):
    return Window.partitionBy(part).orderBy(F.round(score, SCORE_DECIMALS).desc(), F.col(tie).asc())


def _flat(df: DataFrame, method: str) -> DataFrame:
    return df.select(F.col("probe_id").alias("test_idx"), F.lit(method).alias("method"),
                     F.col("rank").cast("int").alias("rank"),
                     F.col("bank_id").alias("train_idx"), F.col("score").cast("double").alias("score"))


def minmax_normalize(df: DataFrame, part: str, col: str, out: str) -> DataFrame:
    """(x - min) / (max - min) per partition; a near-constant range gives 0.

    "Near" is numpy's isclose(max, min): |max - min| <= 1e-8 + 1e-5 * |min|.
    """
    w = Window.partitionBy(part)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    flat = F.abs(hi - lo) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(lo)
    return df.withColumn(out, F.when(flat, F.lit(0.0)).otherwise((F.col(col) - lo) / (hi - lo)))


def bm25_shortlist(probes: DataFrame, bank: DataFrame, cfg: AttributionConfig,
                   index: Bm25Index | None = None) -> DataFrame:
    """(probe_id, bank_id, score, rank) -- the shortlist_n best BM25 rows.

    probes: (idx, text); bank: (idx, text), where rows flagged ``has_text``
    false (vectors without a text) are no documents.
    """
    docs = (bank.where("has_text") if "has_text" in bank.columns else bank).select(F.col("idx").alias("bank_id"), "text")
    index = index or bm25_index(docs, cfg.bm25)
    return bm25_topk(probes.select(F.col("idx").alias("probe_id"), "text"), docs,
                     cfg.shortlist_n, index=index)


def hybrid_debug(probes: DataFrame, bank: DataFrame, cfg: AttributionConfig = AttributionConfig(),
                 shortlist: DataFrame | None = None) -> DataFrame:
    """Every shortlisted row with raw, normalized and blended scores.

    probes/bank: (idx, text, vec). Semantic similarity is the cosine of the
    vectors, computed only for the shortlist rows; a text without a vector has
    similarity 0. The shortlist holds k rows per probe; how it is joined is
    left to adaptive execution, which knows its size by then.
    Returns (test_idx, train_idx, bm25_score, semantic_score, bm25_norm,
    semantic_norm, hybrid_score, rank); rank is the hybrid order.
    """
    sl = bm25_shortlist(probes, bank, cfg) if shortlist is None else shortlist
    pv = probes.select(F.col("idx").alias("probe_id"), l2_normalize("vec").alias("pvec"))
    bv = bank.select(F.col("idx").alias("bank_id"), l2_normalize("vec").alias("bvec"))
    scored = (sl.select("probe_id", "bank_id", F.col("score").alias("bm25_score"))
                .join(pv, "probe_id", "left").join(bv, "bank_id", "left")
                .withColumn("semantic_score", F.coalesce(dot("pvec", "bvec"), F.lit(0.0)))
                .drop("pvec", "bvec"))
    scored = minmax_normalize(scored, "probe_id", "bm25_score", "bm25_norm")
    scored = minmax_normalize(scored, "probe_id", "semantic_score", "semantic_norm")
    scored = scored.withColumn("hybrid_score", F.lit(cfg.alpha) * F.col("bm25_norm")
                               + F.lit(1.0 - cfg.alpha) * F.col("semantic_norm"))
    ranked = scored.withColumn("rank", F.row_number().over(
        _rank_window("probe_id", "hybrid_score", "bank_id")))
    return ranked.select(F.col("probe_id").alias("test_idx"), F.col("bank_id").alias("train_idx"),
                         "bm25_score", "semantic_score", "bm25_norm", "semantic_norm",
                         "hybrid_score", F.col("rank").cast("int").alias("rank"))


def hybrid_topk(probes: DataFrame, bank: DataFrame, cfg: AttributionConfig = AttributionConfig(),
                shortlist: DataFrame | None = None) -> DataFrame:
    """Hybrid rerank of the BM25 shortlist, top k per probe."""
    d = hybrid_debug(probes, bank, cfg, shortlist).where(F.col("rank") <= cfg.top_k)
    return d.select("test_idx", F.lit(HYBRID).alias("method"), "rank", "train_idx",
                    F.col("hybrid_score").alias("score"))


def gradient_cosine_topk(probes: DataFrame, bank: DataFrame, k: int = 5) -> DataFrame:
    """Cosine of gradients (norm clipped at 1e-12) over the whole bank.

    probes/bank: (idx, grad).
    """
    r = dense_topk(probes.select(F.col("idx").alias("probe_id"), F.col("grad").alias("vec")),
                   bank.select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec")),
                   k, metric="cosine")
    return _flat(r, COSINE)


def influence_shortlist_topk(probes: DataFrame, bank: DataFrame,
                             cfg: AttributionConfig = AttributionConfig(),
                             shortlist: DataFrame | None = None) -> DataFrame:
    """Raw gradient dot product on the BM25 shortlist, top k per probe.

    probes/bank: (idx, text, grad); a row without a gradient has influence 0.
    """
    sl = bm25_shortlist(probes, bank, cfg) if shortlist is None else shortlist
    pg = probes.select(F.col("idx").alias("probe_id"), F.col("grad").alias("pg"))
    bg = bank.select(F.col("idx").alias("bank_id"), F.col("grad").alias("bg"))
    s = (sl.select("probe_id", "bank_id").join(pg, "probe_id", "left").join(bg, "bank_id", "left")
           .select("probe_id", "bank_id", F.coalesce(dot("pg", "bg"), F.lit(0.0)).alias("score")))
    r = (s.withColumn("rank", F.row_number().over(_rank_window("probe_id", "score", "bank_id")))
          .where(F.col("rank") <= cfg.top_k))
    return _flat(r, INFLUENCE)


def influence_matrix(probes: DataFrame, bank: DataFrame) -> DataFrame:
    """Every (test, train) gradient dot product, ranked from 1 per test.

    The output has n_test x n_train rows by definition; use only when the full
    matrix is the deliverable. Ranks are distributed running counts, so no task
    holds a probe's whole row. Columns: test_id, train_id, influence_score, rank.
    """
    s = dense_scores(probes.select(F.col("idx").alias("probe_id"), F.col("grad").alias("vec")),
                     bank.select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec")))
    s = s.withColumn("_one", F.lit(1))
    r = prefix_sums(s, [F.round("score", SCORE_DECIMALS).desc(), "bank_id"], ["_one"], partition_by=["probe_id"])
    return r.select(F.col("probe_id").alias("test_id"), F.col("bank_id").alias("train_id"),
                    F.col("score").alias("influence_score"), F.col("cum__one").cast("int").alias("rank"))


def topk_map(ranked: DataFrame, k: int) -> DataFrame:
    """Per probe, the ordered list of (rank, train_id, influence_score).

    ranked: (test_id, train_id, influence_score, rank). Collects at most k
    entries per probe, so the list size is bounded by k.
    """
    top = ranked.where(F.col("rank") <= k)
    return (top.groupBy("test_id")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "train_id", "influence_score")))
                    .alias("topk")))


def merge_methods(*results: DataFrame) -> DataFrame:
    """Union of method results, ordered by (test, method, rank)."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.orderBy("test_idx", "method", "rank")


def method_summary(results: DataFrame) -> DataFrame:
    """Per method -- probes, distinct train rows hit, rows, max rank."""
    return (results.groupBy("method")
                   .agg(F.countDistinct("test_idx").alias("n_probes"),
                        F.countDistinct("train_idx").alias("n_train_hit"),
                        F.count(F.lit(1)).alias("n_rows"),
                        F.max("rank").alias("top_k")))


def attribute_all(probes: DataFrame, bank: DataFrame,
                  cfg: AttributionConfig = AttributionConfig(), shortlist: DataFrame | None = None) -> DataFrame:
    """The three methods over the same probes and bank, sharing one shortlist.

    probes/bank: (idx, text, vec, grad). The shortlist (shortlist_n rows per
    probe) is written once, as both the hybrid and influence methods read it.
    Where it is given (``bm25_shortlist`` of the texts alone), no text is read here.
    """
    sl = (bm25_shortlist(probes, bank, cfg) if shortlist is None else shortlist).select("probe_id", "bank_id", "score").checkpoint()
    return (hybrid_topk(probes, bank, cfg, sl)
            .unionByName(gradient_cosine_topk(probes, bank, cfg.top_k))
            .unionByName(influence_shortlist_topk(probes, bank, cfg, sl)))
