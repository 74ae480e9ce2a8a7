"""Registered evaluation queries: merge (M14, M15), agreement and impact
(E01-E11), membership privacy (P01-P08).

Scores feeding comparisons (ROC thresholds, histogram bins) are rounded to
1e-9 first in both engines so that float noise from a different summation
order cannot split or merge ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.catalog import sql
from trainlens.catalog.attribution_q import CFG, r6, shortlist
from trainlens.operators import agreement as G
from trainlens.operators import attribution as A
from trainlens.operators import privacy as P
from trainlens.registry import register
from trainlens.sources.corpus import text_bank, text_probes, vector_samples

K = CFG.top_k


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three methods over the same test probes and train bank, score rounded to 1e-9."""
    r = A.attribute_all(text_probes(spark, sf_dir), text_bank(spark, sf_dir), CFG, shortlist(spark, sf_dir))
    # k rows per probe and method, read by several branches of each
    # evaluation plan: written once instead of re-deriving all three methods
    return r.withColumn("score", F.round("score", 9)).checkpoint()


MERGED = f"WITH {sql.merged_ctes()},\nm AS (SELECT test_idx, method, rank, train_idx, round(score, 9) AS score FROM merged)"


@register("attribution_merged", MERGED + """
SELECT test_idx, method, rank, train_idx, round(score, 6) AS score FROM m""")
def attribution_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of the three methods, ordered by (test, method, rank)."""
    r = A.merge_methods(merged(spark, sf_dir))
    return r.select("test_idx", "method", "rank", "train_idx", r6("score"))


@register("method_summary", MERGED + """
SELECT method, count(DISTINCT test_idx) AS n_probes, count(DISTINCT train_idx) AS n_train_hit,
       count(*) AS n_rows, max(rank) AS top_k
FROM m GROUP BY method""")
def method_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-method run summary."""
    return A.method_summary(merged(spark, sf_dir))


# ---------------------------------------------------------------- E01-E04
_SHORT = {"hybrid": "hybrid", "gradient_cosine": "cosine", "influence": "influence"}
_PAIRS = [("hybrid", "cosine"), ("hybrid", "influence"), ("cosine", "influence")]


def _agreement_sql(head: str = MERGED) -> str:
    ranks = ",\n".join(
        f"min(rank) FILTER (WHERE method = '{m}') AS rank_{s}" for m, s in _SHORT.items())
    rr = []
    for a, b in _PAIRS:
        both = f"(rank_{a} IS NOT NULL AND rank_{b} IS NOT NULL)"
        rr.append(f"{both} AS both_{a}_{b}")
        rr.append(f"CASE WHEN {both} THEN rank() OVER (PARTITION BY test_idx, {both} ORDER BY rank_{a}) END AS ca_{a}_{b}")
        rr.append(f"CASE WHEN {both} THEN rank() OVER (PARTITION BY test_idx, {both} ORDER BY rank_{b}) END AS cb_{a}_{b}")
    aggs = []
    for a, b in _PAIRS:
        n = f"count(*) FILTER (WHERE both_{a}_{b})"
        aggs.append(f"CAST({n} AS DOUBLE) / {K} AS {a}_vs_{b}_overlap")
        aggs.append(f"CASE WHEN {n} >= 2 THEN corr(ca_{a}_{b}, cb_{a}_{b}) END AS {a}_vs_{b}_rank")
        aggs.append(f"CAST({n} AS INTEGER) AS {a}_vs_{b}_common")
    for s in _SHORT.values():
        aggs.append(f"coalesce(string_agg(CAST(train_idx AS VARCHAR), ',' ORDER BY rank_{s}) "
                    f"FILTER (WHERE rank_{s} IS NOT NULL), '') AS {s}_topk")
    return head + f""",
cp AS (SELECT test_idx FROM m GROUP BY test_idx HAVING count(DISTINCT method) = 3),
mem AS (SELECT test_idx, train_idx, {ranks}
        FROM m WHERE rank <= {K} AND test_idx IN (SELECT test_idx FROM cp) GROUP BY test_idx, train_idx),
rr AS (SELECT *, {", ".join(rr)} FROM mem),
agree AS (SELECT test_idx, {", ".join(aggs)} FROM rr GROUP BY test_idx)"""


def _agreement(spark, sf_dir) -> DataFrame:
    return _lists_as_text(G.agreement(merged(spark, sf_dir), K))


def _lists_as_text(a: DataFrame) -> DataFrame:
    for s in _SHORT.values():
        a = a.withColumn(f"{s}_topk", F.concat_ws(",", F.transform(f"{s}_topk", lambda x: x.cast("string"))))
    return a


_AGREE_COLS = ([f"{a}_vs_{b}_{x}" for a, b in _PAIRS for x in ("overlap", "rank", "common")]
               + [f"{s}_topk" for s in _SHORT.values()])


@register("method_agreement", _agreement_sql() + "\nSELECT test_idx, " + ", ".join(
    f"round({c}, 6) AS {c}" if c.endswith(("overlap", "rank")) else c for c in _AGREE_COLS) + " FROM agree")
def method_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per common probe, top-k overlaps, Spearman on common items, id lists."""
    a = _agreement(spark, sf_dir)
    return a.select("test_idx", *[r6(c) if c.endswith(("overlap", "rank")) else c for c in _AGREE_COLS])


_CASES = f"WITH {sql.merged_ctes('shadow')},\nm AS (SELECT test_idx, method, rank, train_idx, round(score, 9) AS score FROM merged)"


@register("case_study", _agreement_sql(_CASES) + "\nSELECT test_idx, " + ", ".join(
    f"round({c}, 6) AS {c}" if c.endswith(("overlap", "rank")) else c for c in _AGREE_COLS) + " FROM agree")
def case_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad-hoc probes (the shadow samples that have a text), each with the
    three ranked lists and their overlaps."""
    a = _lists_as_text(G.case_study(text_probes(spark, sf_dir, "shadow"), text_bank(spark, sf_dir), CFG, shortlist(spark, sf_dir, "shadow")))
    return a.select("test_idx", *[r6(c) if c.endswith(("overlap", "rank")) else c for c in _AGREE_COLS])


@register("method_score_lists", MERGED + f"""
SELECT test_idx, method, string_agg(printf('%.6f', round(score, 6) + 0.0), ',' ORDER BY rank) AS scores
FROM m WHERE rank <= {K} GROUP BY test_idx, method""")
def method_score_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per test probe and method, the scores in rank order."""
    s = G.score_lists(merged(spark, sf_dir), K)
    return s.select("test_idx", "method", F.concat_ws(",", F.transform(
        "scores", lambda x: F.format_string("%.6f", F.round(x, 6) + F.lit(0.0)))).alias("scores"))


def _matrix_sql() -> str:
    rows = []
    for a, b in _PAIRS:
        for x, y in ((a, b), (b, a)):
            rows.append(f"SELECT '{x}' AS method_a, '{y}' AS method_b, avg({a}_vs_{b}_rank) AS mean_rank_corr, "
                        f"avg({a}_vs_{b}_overlap) AS mean_overlap FROM agree")
    for s in _SHORT.values():
        rows.append(f"SELECT '{s}', '{s}', 1.0, CAST(NULL AS DOUBLE)")
    return _agreement_sql() + ",\nmx AS (" + "\nUNION ALL ".join(rows) + ")"


@register("agreement_matrix", _matrix_sql() + """
SELECT method_a, method_b, round(mean_rank_corr, 6) AS mean_rank_corr, round(mean_overlap, 6) AS mean_overlap
FROM mx""")
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E05 + E06: mean Spearman (NaN ignored, diagonal 1) and mean overlap per method pair."""
    m = G.agreement_matrix(G.agreement(merged(spark, sf_dir), K))
    return m.select("method_a", "method_b", r6("mean_rank_corr"), r6("mean_overlap"))


# ---------------------------------------------------------------- E07-E10
_IMPACT = MERGED + """,
imp AS (SELECT *, -score AS approx_loss_change FROM m WHERE method IN ('gradient_cosine', 'influence'))"""


@register("loss_impact", _IMPACT + """
SELECT test_idx, method, rank, train_idx, round(score, 6) AS score,
       round(approx_loss_change, 6) + 0.0 AS approx_loss_change FROM imp""")
def loss_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-order loss change (-score) for gradient cosine and influence rows."""
    i = G.loss_impact(merged(spark, sf_dir))
    return i.select("test_idx", "method", "rank", "train_idx", r6("score"), r6("approx_loss_change"))


@register("loss_impact_summary", _IMPACT + """
SELECT method, count(approx_loss_change) AS n, round(avg(approx_loss_change), 6) AS mean_change,
       round(stddev_pop(approx_loss_change), 6) AS std_change
FROM imp WHERE NOT isnan(approx_loss_change) GROUP BY method""")
def loss_impact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and population std of the loss change per method."""
    s = G.loss_impact_summary(G.loss_impact(merged(spark, sf_dir)))
    return s.select("method", "n", r6("mean_change"), r6("std_change"))


BINS = 20


@register("loss_impact_histogram", _IMPACT + f""",
rng AS (SELECT method, CASE WHEN min(approx_loss_change) = max(approx_loss_change) THEN min(approx_loss_change) - 0.5
                            ELSE min(approx_loss_change) END AS lo,
                       CASE WHEN min(approx_loss_change) = max(approx_loss_change) THEN max(approx_loss_change) + 0.5
                            ELSE max(approx_loss_change) END AS hi
        FROM imp GROUP BY method),
b AS (SELECT imp.method, least(CAST(floor((approx_loss_change - lo) / ((hi - lo) / {BINS})) AS INTEGER), {BINS - 1}) AS bin
      FROM imp JOIN rng USING (method)),
c AS (SELECT method, bin, count(*) AS cnt FROM b GROUP BY method, bin),
g AS (SELECT method, lo, hi, CAST(unnest(range(0, {BINS})) AS INTEGER) AS bin FROM rng)
SELECT g.method, g.bin, round(lo + g.bin * ((hi - lo) / {BINS}), 6) AS bin_lo,
       round(lo + (g.bin + 1) * ((hi - lo) / {BINS}), 6) AS bin_hi, coalesce(c.cnt, 0) AS count
FROM g LEFT JOIN c ON c.method = g.method AND c.bin = g.bin""")
def loss_impact_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20-bin histogram of the loss change per method (data behind the plot)."""
    h = G.histogram(G.loss_impact(merged(spark, sf_dir)), "method", "approx_loss_change", BINS)
    return h.select("method", "bin", r6("bin_lo"), r6("bin_hi"), "count")


PROBE_BINS = 40


@register("probe_score_histogram", f"""
WITH s AS ({sql.vector_samples_sql()}),
sc AS (SELECT p.idx AS test_idx, round(list_dot_product(p.grad, b.grad), 9) AS v
       FROM (SELECT * FROM s WHERE split = 'test') p CROSS JOIN (SELECT * FROM s WHERE split = 'train') b),
rng AS (SELECT test_idx, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
               CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM sc GROUP BY test_idx),
b AS (SELECT test_idx, least(CAST(floor((v - lo) / ((hi - lo) / {PROBE_BINS})) AS INTEGER), {PROBE_BINS - 1}) AS bin
      FROM sc JOIN rng USING (test_idx)),
c AS (SELECT test_idx, bin, count(*) AS cnt FROM b GROUP BY test_idx, bin),
g AS (SELECT test_idx, lo, hi, CAST(unnest(range(0, {PROBE_BINS})) AS INTEGER) AS bin FROM rng)
SELECT g.test_idx, g.bin, round(lo + g.bin * ((hi - lo) / {PROBE_BINS}), 6) AS bin_lo,
       round(lo + (g.bin + 1) * ((hi - lo) / {PROBE_BINS}), 6) AS bin_hi, coalesce(c.cnt, 0) AS count
FROM g LEFT JOIN c ON c.test_idx = g.test_idx AND c.bin = g.bin""")
def probe_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40-bin histogram of every test probe's influence scores over the
    whole train bank (data behind the plot)."""
    s = vector_samples(spark, sf_dir)
    h = G.probe_score_histogram(s.where(F.col("split") == "test"), s.where(F.col("split") == "train"), PROBE_BINS)
    return h.select("test_idx", "bin", r6("bin_lo"), r6("bin_hi"), "count")


@register("method_disagreement", MERGED + f""",
g AS (SELECT test_idx, train_idx, count(DISTINCT method) AS n, min(method) AS m1
      FROM m WHERE rank <= {K} GROUP BY test_idx, train_idx)
SELECT test_idx, train_idx, CASE WHEN n = 3 THEN 'all_agree' ELSE 'only_' || m1 END AS category
FROM g WHERE n = 3 OR n = 1""")
def method_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train rows all methods agree on, and rows only one method found."""
    return G.disagreements(merged(spark, sf_dir), K)


# ---------------------------------------------------------------- E11
def _shingles_sql(t: str, n: int = 3) -> str:
    return (f"list_distinct(list_transform(range(1, greatest(len({t}) - {n - 1}, 1) + 1), "
            f"lambda i: array_to_string({t}[i:i + {n - 1}], ' ')))")


@register("retrieval_audit", MERGED + f""",
au AS (SELECT m.test_idx, m.method, m.rank, m.train_idx,
              {sql.tokens('p.text')} AS pt, {sql.tokens("' ' || coalesce(d.text, '')")} AS dt
       FROM m JOIN ts p ON p.idx = m.test_idx LEFT JOIN documents d ON d.doc_id = m.train_idx
       WHERE m.rank <= {K}),
sh AS (SELECT *, {_shingles_sql('pt')} AS ga, {_shingles_sql('dt')} AS gb FROM au)
SELECT test_idx, method, rank, train_idx,
       round(CASE WHEN len(pt) >= 3 THEN
         CAST(len(list_distinct(list_intersect(ga, gb))) AS DOUBLE) / len(ga) END, 6) AS text_overlap
FROM sh""")
def retrieval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-trigram containment of each probe text in its retrieved rows."""
    probe_text = text_probes(spark, sf_dir).select(F.col("idx").alias("test_idx"), F.col("text").alias("probe_text"))
    from trainlens.sources.tables import read_table
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("train_idx"), F.col("text").alias("instruction"), F.lit("").alias("output"))
    a = G.retrieval_audit(merged(spark, sf_dir), probe_text, docs, K)
    return a.select("test_idx", "method", "rank", "train_idx", r6("text_overlap"))


# ---------------------------------------------------------------- P01-P08
def _privacy_scores(spark, sf_dir) -> DataFrame:
    s = vector_samples(spark, sf_dir).select("idx", "split", "grad")
    sc = P.privacy_scores(s.where(F.col("split") == "train"), s.where(F.col("split") == "shadow"),
                          s.where(F.col("split") == "train"))
    return sc.select("label", "probe_split", "probe_idx", *[F.round(c, 9).alias(c) for c in P.SCORE_COLUMNS])


_PRIV = f"""WITH {sql.samples_ctes()},
tr AS (SELECT idx, grad FROM s WHERE split = 'train'),
sh AS (SELECT idx, grad FROM s WHERE split = 'shadow'),
mem AS (SELECT p.idx AS probe_idx, max({sql.cosine('p.grad', 'b.grad')}) AS max_cosine,
               max(list_dot_product(p.grad, b.grad)) AS max_influence
        FROM (SELECT * FROM tr ORDER BY idx LIMIT {P.PROBES}) p JOIN tr b ON p.idx <> b.idx GROUP BY p.idx),
non AS (SELECT p.idx AS probe_idx, max({sql.cosine('p.grad', 'b.grad')}) AS max_cosine,
               max(list_dot_product(p.grad, b.grad)) AS max_influence
        FROM (SELECT * FROM sh ORDER BY idx LIMIT {P.PROBES}) p CROSS JOIN tr b GROUP BY p.idx),
ps AS (SELECT 1 AS label, 'train' AS probe_split, probe_idx, round(max_cosine, 9) AS max_cosine,
              round(max_influence, 9) AS max_influence FROM mem
       UNION ALL
       SELECT 0, 'shadow', probe_idx, round(max_cosine, 9), round(max_influence, 9) FROM non),
lng AS (SELECT 'max_cosine' AS metric, label, max_cosine AS score FROM ps
        UNION ALL SELECT 'max_influence', label, max_influence FROM ps),
cnt AS (SELECT metric, score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
               sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg FROM lng GROUP BY metric, score),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY metric ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
               sum(neg) OVER (PARTITION BY metric ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg
        FROM cnt),
tot AS (SELECT metric, sum(pos) AS P, sum(neg) AS N FROM cnt GROUP BY metric),
auc AS (SELECT metric, sum(pos * ((N - cum_neg) + 0.5 * neg)) / (any_value(P) * any_value(N)) AS auc
        FROM cum JOIN tot USING (metric) GROUP BY metric),
curve AS (SELECT metric, 'Infinity'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr FROM tot
          UNION ALL SELECT metric, score, cum_neg / N, cum_pos / P FROM cum JOIN tot USING (metric)),
f80 AS (SELECT metric, fpr AS fpr_at_tpr_0_8 FROM (
          SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(tpr - 0.8), threshold DESC) AS r
          FROM curve) WHERE r = 1),
acc AS (SELECT metric, acc AS best_accuracy, score AS best_threshold FROM (
          SELECT *, row_number() OVER (PARTITION BY metric ORDER BY acc DESC, score ASC) AS r FROM (
            SELECT cum.*, (cum_pos + (N - cum_neg)) / (P + N) AS acc FROM cum JOIN tot USING (metric)))
        WHERE r = 1),
met AS (SELECT * FROM auc JOIN f80 USING (metric) JOIN acc USING (metric))"""


@register("privacy_scores", _PRIV + """
SELECT label, probe_split, probe_idx, round(max_cosine, 6) AS max_cosine,
       round(max_influence, 6) AS max_influence FROM ps""")
def privacy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01 + P02: strongest cosine and dot match of the sampled members (self
    excluded) and non-members against the whole train bank."""
    s = _privacy_scores(spark, sf_dir)
    return s.select("label", "probe_split", "probe_idx", r6("max_cosine"), r6("max_influence"))


@register("privacy_metrics", _PRIV + """
SELECT metric, round(auc, 6) AS auc, round(fpr_at_tpr_0_8, 6) AS fpr_at_tpr_0_8,
       round(best_accuracy, 6) AS best_accuracy, round(best_threshold, 6) AS best_threshold FROM met""")
def privacy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, FPR at TPR 0.8, best threshold accuracy per attack score."""
    m = P.privacy_metrics(_privacy_scores(spark, sf_dir))
    return m.select("metric", r6("auc"), r6("fpr_at_tpr_0_8"), r6("best_accuracy"), r6("best_threshold"))


@register("privacy_roc", _PRIV + """
SELECT metric, round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve""")
def privacy_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC points per attack score, starting at (+inf, 0, 0)."""
    c = P.roc_curve(P.score_counts(_privacy_scores(spark, sf_dir)))
    return c.select("metric", r6("threshold"), r6("fpr"), r6("tpr"))


@register("privacy_verdict", _PRIV + """
SELECT round(auc_cosine, 6) AS auc_cosine, round(auc_influence, 6) AS auc_influence,
       CASE WHEN auc_cosine < 0.55 AND auc_influence < 0.55 THEN 'none'
            WHEN auc_cosine > auc_influence THEN 'cosine' ELSE 'influence' END AS stronger_signal
FROM (SELECT max(auc) FILTER (WHERE metric = 'max_cosine') AS auc_cosine,
             max(auc) FILTER (WHERE metric = 'max_influence') AS auc_influence FROM met)""")
def privacy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which attack score carries the stronger membership signal."""
    v = P.verdict(P.privacy_metrics(_privacy_scores(spark, sf_dir)))
    return v.select(r6("auc_cosine"), r6("auc_influence"), "stronger_signal")
