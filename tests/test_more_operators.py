import os
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trainlens.operators import agreement as G
from trainlens.operators import attribution as A
from trainlens.operators import examples as X
from trainlens.operators import gates as GT
from trainlens.operators import lengths as L
from trainlens.operators import vectors as V


def _vecs(spark, ids, M):
    return spark.createDataFrame(pd.DataFrame({"idx": ids, "grad": list(M)}))


def test_probe_score_profile_and_full_matrix(spark):
    rng = np.random.default_rng(5)
    Q, B = rng.normal(size=(6, 4)).round(1), rng.normal(size=(40, 4)).round(1)
    B[7] = B[8]
    prof = G.probe_score_profile(_vecs(spark, range(100, 106), Q), _vecs(spark, range(40), B)).toPandas()
    S = Q @ B.T
    for i, p in enumerate(range(100, 106)):
        row = prof[prof.test_idx == p].iloc[0]
        cut = np.sort(S[i])[-5]
        assert row.cutoff == pytest.approx(cut)
        assert row.mean_score == pytest.approx(S[i].mean())
        assert row.pct_at_or_above == pytest.approx((np.round(S[i], 9) >= round(cut, 9)).mean() * 100)
    m = A.influence_matrix(_vecs(spark, range(100, 106), Q), _vecs(spark, range(40), B)).toPandas()
    assert len(m) == 6 * 40
    got = m.set_index(["test_id", "train_id"]).influence_score
    assert got.loc[(101, 3)] == pytest.approx(S[1, 3])


def test_step_and_rate_resolution(spark):
    df = spark.createDataFrame([(120, 10, 60.0, 2.0), (None, None, 60.0, 2.5), (None, 0, 61.0, 0.5)],
                               "state int, metric int, runtime double, rate double")
    steps, flag = L.resolve_steps(F.col("state"), F.col("metric"), F.col("runtime"), F.col("rate"))
    got = [(r.s, r.f) for r in df.select(steps.alias("s"), flag.alias("f")).collect()]
    assert got == [(120, False), (150, True), (30, True)]  # 30.5 rounds half to even
    r = df.select(L.token_rate_estimate(F.lit(100.0), F.lit(4), F.lit(1), F.lit(10), F.col("runtime"))
                  .alias("t")).first().t
    assert r == pytest.approx(100 * 4 * 10 / 60.0)
    res = spark.createDataFrame([("0", 5.0, 3.0), ("x", -1.0, 3.0)], "m string, rep double, est double") \
        .select(L.resolve_token_rate("m", "rep", "est").alias("v")).collect()
    assert [x.v for x in res] == [5.0, 3.0]


def test_cache_writers_and_artifact_hashes(spark, tmp_dir):
    df = spark.createDataFrame([("a", "x y")], "sample_id string, text string")
    key = X.CacheKey("d", "ws", 8, "longest").digest()
    calls = []

    def build():
        calls.append(1)
        return X.tokenize(df, 8)
    X.cached(spark, tmp_dir, key, build)
    X.cached(spark, tmp_dir, key, build)
    assert len(calls) == 1
    assert X.CacheKey("d", "ws", 16, "longest").digest() != key
    root = os.path.join(tmp_dir, "runs")
    for run, content in (("r1", b"abc"), ("r2", b"abc")):
        os.makedirs(os.path.join(root, run))
        with open(os.path.join(root, run, "metrics.json"), "wb") as f:
            f.write(content)
    cmp = GT.compare_artifacts(GT.artifact_hashes(spark, root), "r1", "r2").collect()
    assert [r.match for r in cmp] == [True]


def test_exact_overlap_ratio(spark):
    df = spark.createDataFrame([("Hello World", "hello there world")], "a string, b string")
    got = df.select(G.sequence_ratio(F.col("a"), F.col("b")).alias("r")).first().r
    assert got == pytest.approx(SequenceMatcher(None, "hello world", "hello there world").ratio())


def test_state_and_id_audits(spark):
    from trainlens.operators import gates as G
    from trainlens.operators import normalize as N
    from trainlens.sources import io
    states = spark.createDataFrame([("a", '{"global_step": 3}'), ("b", '{"log_history": []}'), ("c", "{}"), ("d", "no json")],
                                   "run_id string, trainer_state string")
    assert sorted(r.run_id for r in G.state_audit(states).collect()) == ["c", "d"]
    N.assert_unique_ids(spark.createDataFrame([("a",), ("b",)], "sample_id string"))
    with pytest.raises(ValueError, match="duplicate sample_id: 'a'"):
        N.assert_unique_ids(spark.createDataFrame([("a",), (" a",)], "sample_id string"))
    recs = spark.createDataFrame([(0, {"x": "1"})], "ordinal long, record map<string,string>")
    assert io.record_columns(recs, ["x", "y"]).first().asDict() == {"ordinal": 0, "x": "1", "y": None}


def test_effective_lengths_add_up(spark):
    from trainlens.operators import lengths as L
    tok = spark.createDataFrame([("a", [1, 2], [1, 1]), ("b", [3, 0, 0], [1, 0, 0])], "sample_id string, input_ids array<int>, attention_mask array<int>")
    assert L.count_tokens(tok).first().n_tokens == 3


def test_token_rates_and_steps(spark):
    """Every branch of both resolutions."""
    from trainlens.operators import lengths as L
    df = spark.createDataFrame([(1, 5.0, 4.0, 3.0, 7, 9, 10.0, 1.5), (2, 0.0, 4.0, 3.0, 0, 9, 10.0, 1.5),
                                (3, None, None, 3.0, None, None, 10.0, 1.25), (4, None, None, None, None, 0, 0.0, 2.0)],
                               "id int, measured double, reported double, estimated double, state int, metric int, runtime double, rate double")
    steps, flag = L.resolve_steps(F.col("state"), F.col("metric"), F.col("runtime"), F.col("rate"))
    got = {r.id: (r.r, r.s, r.f) for r in df.select("id", L.resolve_token_rate("measured", "reported", "estimated").alias("r"),
                                                     steps.alias("s"), flag.alias("f")).collect()}
    assert got == {1: (5.0, 7, False), 2: (4.0, 9, False), 3: (3.0, 12, True), 4: (0.0, 0, True)}
