import math

import numpy as np
import pandas as pd
import pytest

from trainlens.operators import agreement as G
from trainlens.operators import privacy as P
from trainlens.operators.lexical import Bm25Params, bm25_topk


def test_bm25_hand_computed(spark):
    docs = spark.createDataFrame([(0, "the cat sat"), (1, "the dog"), (2, "cat cat cat bird")],
                                 "bank_id long, text string")
    probes = spark.createDataFrame([(9, "Cat the")], "probe_id long, text string")
    got = bm25_topk(probes, docs, 3).toPandas().sort_values("rank")
    toks = [d.split() for d in ["the cat sat", "the dog", "cat cat cat bird"]]
    n, avgdl = 3, sum(map(len, toks)) / 3
    vocab = {t for d in toks for t in d}
    raw = {t: math.log(n - sum(t in d for d in toks) + 0.5) - math.log(sum(t in d for d in toks) + 0.5)
           for t in vocab}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: (floor if v < 0 else v) for t, v in raw.items()}
    p = Bm25Params()

    def score(d):
        s = 0.0
        for q in ["cat", "the"]:
            tf = d.count(q)
            s += idf[q] * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(d) / avgdl))
        return s
    exp = sorted(((round(score(d), 9), i, score(d)) for i, d in enumerate(toks)), key=lambda t: (-t[0], t[1]))
    assert list(got.bank_id) == [i for _, i, _ in exp]
    assert np.allclose(got.score, [s for _, _, s in exp])


def _results(spark):
    rows = []
    for t, lists in {1: {"hybrid": [1, 2, 3], "gradient_cosine": [3, 2, 9], "influence": [7, 8, 1]},
                     2: {"hybrid": [4, 5, 6], "gradient_cosine": [4, 5, 6], "influence": [6, 5, 4]}}.items():
        for m, ids in lists.items():
            rows += [(t, m, r + 1, i, 1.0 / (r + 1)) for r, i in enumerate(ids)]
    return spark.createDataFrame(rows, "test_idx long, method string, rank int, train_idx long, score double")


def test_overlap_and_spearman(spark):
    a = G.agreement(_results(spark), 3).toPandas().set_index("test_idx")
    assert a.loc[1, "hybrid_vs_cosine_overlap"] == pytest.approx(2 / 3)
    # common items 2, 3: hybrid ranks (2, 3) vs cosine (2, 1) -> rho -1
    assert a.loc[1, "hybrid_vs_cosine_rank"] == pytest.approx(-1.0)
    assert pd.isna(a.loc[1, "cosine_vs_influence_rank"])  # one common item
    assert a.loc[2, "cosine_vs_influence_rank"] == pytest.approx(-1.0)
    assert list(a.loc[1, "influence_topk"]) == [7, 8, 1]
    d = {(r.test_idx, r.train_idx): r.category for r in G.disagreements(_results(spark), 3).collect()}
    assert d[(2, 4)] == "all_agree" and d[(1, 7)] == "only_influence"


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", 5.0)], "g string, v double")
    h = G.histogram(df, "g", "v", 4).toPandas().sort_values(["g", "bin"])
    assert h[h.g == "a"]["count"].tolist() == [3, 2, 2, 3]
    assert h[h.g == "b"]["count"].sum() == 1 and len(h[h.g == "b"]) == 4


def _auc_brute(y, s):
    pos = [v for v, l in zip(s, y) if l == 1]
    neg = [v for v, l in zip(s, y) if l == 0]
    return sum(1.0 if p > q else 0.5 if p == q else 0.0 for p in pos for q in neg) / (len(pos) * len(neg))


def test_privacy_metrics_against_brute_force(spark):
    rng = np.random.default_rng(0)
    y = [1] * 40 + [0] * 30
    s1 = np.round(rng.normal(size=70) + np.array(y) * 0.5, 1)
    s2 = np.round(rng.normal(size=70), 1)
    pdf = pd.DataFrame({"label": y, "probe_split": ["x"] * 70, "probe_idx": range(70),
                        "max_cosine": s1, "max_influence": s2})
    m = P.privacy_metrics(spark.createDataFrame(pdf)).toPandas().set_index("metric")
    for col, s in (("max_cosine", s1), ("max_influence", s2)):
        assert m.loc[col, "auc"] == pytest.approx(_auc_brute(y, list(s)))
        best, thr = 0.0, None
        for t in np.unique(s):
            acc = np.mean((s >= t).astype(int) == np.array(y))
            if acc > best:
                best, thr = acc, t
        assert m.loc[col, "best_accuracy"] == pytest.approx(best)
        assert m.loc[col, "best_threshold"] == pytest.approx(thr)
    v = P.verdict(spark.createDataFrame(m.reset_index())).first()
    assert v.stronger_signal in ("none", "cosine", "influence")


def _bm25_brute(docs, probes, k, p=Bm25Params()):
    toks = {i: t.lower().split() for i, t in docs}
    n = len(toks)
    avgdl = sum(map(len, toks.values())) / n
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = p.epsilon * sum(raw.values()) / len(raw)
    idf = {w: (floor if v < 0 else v) for w, v in raw.items()}
    out = {}
    for pid, q in probes:
        sc = []
        for i, t in toks.items():
            s = 0.0
            for w in q.lower().split():
                tf = t.count(w)
                s += idf.get(w, 0.0) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(t) / avgdl))
            sc.append((round(s, 9), i))
        sc.sort(key=lambda x: (-x[0], x[1]))
        out[pid] = [i for _, i in sc[:k]]
    return out


def test_bm25_at_one_and_many_groups_agrees_with_brute_force(spark):
    rng = np.random.default_rng(2)
    vocab = ["the", "a", "cat", "dog", "bird", "fish", "red", "blue", "x", "y"]
    docs = [(i, " ".join(rng.choice(vocab, rng.integers(0, 12)))) for i in range(60)]
    probes = [(100 + j, " ".join(rng.choice(vocab + ["zzz"], 4))) for j in range(7)]
    ddf = spark.createDataFrame(docs, "bank_id long, text string").repartition(3)
    pdf = spark.createDataFrame(probes, "probe_id long, text string")
    exp = _bm25_brute(docs, probes, 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        one = bm25_topk(pdf, ddf, 8).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    many = bm25_topk(pdf, ddf, 8, group_bytes=100).toPandas()
    for got in (one, many):
        for pid, ids in exp.items():
            assert list(got[got.probe_id == pid].sort_values("rank").bank_id) == ids
