"""Membership-inference leakage of attribution scores.

Member probes are the first ``m`` train rows scored against the train bank
without their own row; non-member probes are the first ``m`` shadow rows (the
sample size is part of the method). Each probe's strongest match (cosine and
raw dot) is the attack score; one pass over the bank gives both for all probes.
ROC quantities are computed from counts per distinct score with distributed
running sums, never one global window. Without members or non-members the
rates are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlens.plans.blocked_topk import dense_max
from trainlens.plans.ordinal import prefix_sums

SCORE_COLUMNS = ("max_cosine", "max_influence")
PROBES = 50  # fixed value: members and non-members scored


def privacy_scores(members: DataFrame, nonmembers: DataFrame, bank: DataFrame, m: int | None = PROBES) -> DataFrame:
    """P01 + P02: (label, probe_split, probe_idx, max_cosine, max_influence).

    members/nonmembers/bank: (idx, grad). Members are expected to be bank
    rows; a probe's own row is excluded from its maximum (non-members have
    none). ``m`` is the number of each, in idx order; None takes all.
    """
    first = lambda df: df.orderBy("idx").limit(m) if m is not None else df
    probes = (first(members).select(F.lit(1).alias("label"), F.lit("train").alias("probe_split"), "idx", "grad")
              .unionByName(first(nonmembers).select(F.lit(0).alias("label"), F.lit("shadow").alias("probe_split"), "idx", "grad")))
    top = dense_max(probes.select(F.col("idx").alias("probe_id"), F.col("grad").alias("vec")),
                    bank.select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec")), exclude_self=True)
    return (probes.join(top, probes.idx == top.probe_id)
            .select("label", "probe_split", F.col("probe_id").alias("probe_idx"), "max_cosine", F.col("max_dot").alias("max_influence")))


def _long(scores: DataFrame) -> DataFrame:
    """(metric, label, score) for every score column."""
    parts = [scores.select(F.lit(c).alias("metric"), "label", F.col(c).alias("score"))
             for c in SCORE_COLUMNS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score_counts(scores: DataFrame, m: int | None = PROBES) -> DataFrame:
    """Per metric and distinct score: positives, negatives, and running counts
    from the highest score down (cum_pos/cum_neg include the score itself).
    With ``m`` members and non-members there are at most 2 m scores a metric, a
    window's work; None (any number) takes distributed running sums."""
    c = (_long(scores).groupBy("metric", "score")
         .agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).cast("long").alias("pos"),
              F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).cast("long").alias("neg")))
    if m is not None:
        w = Window.partitionBy("metric").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
        return c.select("*", *[F.sum(x).over(w).alias(f"cum_{x}") for x in ("pos", "neg")])
    return prefix_sums(c, [F.col("score").desc()], ["pos", "neg"], partition_by=["metric"])


def _totals(counts: DataFrame) -> DataFrame:
    """One row per score column, so always small enough to broadcast."""
    return F.broadcast(counts.groupBy("metric").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))


def roc_auc(counts: DataFrame) -> DataFrame:
    """AUC by rank sum; tied scores count one half."""
    t = _totals(counts)
    below = F.col("N") - F.col("cum_neg")  # negatives with a strictly lower score
    return (counts.join(t, "metric")
                  .groupBy("metric")
                  .agg(F.try_divide(F.sum(F.col("pos") * (below + 0.5 * F.col("neg"))),
                                    F.first("P") * F.first("N")).alias("auc")))


def roc_curve(counts: DataFrame) -> DataFrame:
    """(metric, threshold, fpr, tpr) for every distinct score plus the
    (+inf, 0, 0) start; predict member when score >= threshold."""
    t = _totals(counts)
    pts = (counts.join(t, "metric")
                 .select("metric", F.col("score").alias("threshold"),
                         F.try_divide("cum_neg", "N").alias("fpr"),
                         F.try_divide("cum_pos", "P").alias("tpr")))
    start = t.select("metric", F.lit(float("inf")).alias("threshold"),
                     F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def fpr_at_tpr(curve: DataFrame, target: float = 0.8) -> DataFrame:
    """FPR at the curve point whose TPR is nearest the target (first in
    curve order, i.e. the highest threshold, wins ties)."""
    nearest = F.struct(F.abs(F.col("tpr") - target), -F.col("threshold"))
    return curve.groupBy("metric").agg(F.min_by("fpr", nearest).alias("fpr_at_tpr_0_8"))


def best_threshold_accuracy(counts: DataFrame) -> DataFrame:
    """Best accuracy of (score >= t) over distinct scores; lowest t on ties."""
    t = _totals(counts)
    acc = F.try_divide(F.col("cum_pos") + (F.col("N") - F.col("cum_neg")), F.col("P") + F.col("N"))
    best = F.struct(F.col("acc"), -F.col("score"))
    return (counts.join(t, "metric").withColumn("acc", acc).groupBy("metric")
                  .agg(F.max("acc").alias("best_accuracy"), F.max_by("score", best).alias("best_threshold")))


def privacy_metrics(scores: DataFrame) -> DataFrame:
    """One row per score column with AUC, FPR@TPR0.8 and best accuracy.

    The running counts (one row per distinct score) feed three branches, so
    they are written once.
    """
    counts = score_counts(scores).checkpoint()
    return (roc_auc(counts)
            .join(fpr_at_tpr(roc_curve(counts)), "metric")
            .join(best_threshold_accuracy(counts), "metric"))


def verdict(metrics: DataFrame, floor: float = 0.55) -> DataFrame:
    """Which score leaks more: both AUC < floor -> none; tie -> influence."""
    pv = metrics.groupBy().agg(
        F.max(F.when(F.col("metric") == "max_cosine", F.col("auc"))).alias("auc_cosine"),
        F.max(F.when(F.col("metric") == "max_influence", F.col("auc"))).alias("auc_influence"))
    v = (F.when((F.col("auc_cosine") < floor) & (F.col("auc_influence") < floor), F.lit("none"))
          .when(F.col("auc_cosine") > F.col("auc_influence"), F.lit("cosine"))
          .otherwise(F.lit("influence")))
    return pv.withColumn("stronger_signal", v)
