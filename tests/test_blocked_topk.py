import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from trainlens.plans.blocked_topk import dense_count_at_least, dense_max, dense_topk, sparse_topk, vector_violations


def _brute(P, B, pids, bids, k, metric, exclude_self=False):
    if metric == "cosine":
        P = P / np.clip(np.linalg.norm(P, axis=1, keepdims=True), 1e-12, None)
        B = B / np.clip(np.linalg.norm(B, axis=1, keepdims=True), 1e-12, None)
    S = P @ B.T
    out = {}
    for i, p in enumerate(pids):
        cand = [(round(S[i, j], 9), b, S[i, j]) for j, b in enumerate(bids) if not (exclude_self and b == p)]
        cand.sort(key=lambda t: (-t[0], t[1]))
        out[p] = [(b, s) for _, b, s in cand[:k]]
    return out


def _frame(spark, ids, M, name):
    return spark.createDataFrame(pd.DataFrame({name: ids, "vec": list(M)}))


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_dense_topk_matches_brute_force_across_groups(spark, metric):
    rng = np.random.default_rng(7)
    P = rng.normal(size=(23, 5)).round(1)
    B = rng.normal(size=(57, 5)).round(1)
    B[10] = B[3]  # exact ties must break on the lower id
    pids, bids = np.arange(100, 123), np.arange(0, 57)
    got = dense_topk(_frame(spark, pids, P, "probe_id"), _frame(spark, bids, B, "bank_id"), 4,
                     metric=metric, group_bytes=300).toPandas()
    exp = _brute(P, B, pids, bids, 4, metric)
    assert len(got) == 23 * 4
    for p, rows in exp.items():
        g = got[got.probe_id == p].sort_values("rank")
        assert list(g.bank_id) == [b for b, _ in rows]
        assert np.allclose(g.score, [s for _, s in rows])
        assert list(g["rank"]) == [1, 2, 3, 4]


def test_dense_topk_exclude_self_and_max(spark):
    rng = np.random.default_rng(3)
    M = rng.normal(size=(30, 4))
    ids = np.arange(30)
    got = dense_topk(_frame(spark, ids, M, "probe_id"), _frame(spark, ids, M, "bank_id"), 1,
                     metric="cosine", exclude_self=True, group_bytes=200).toPandas()
    exp = _brute(M, M, ids, ids, 1, "cosine", exclude_self=True)
    for p, rows in exp.items():
        assert got[got.probe_id == p].bank_id.iloc[0] == rows[0][0]
    mx = dense_max(_frame(spark, ids, M, "probe_id"), _frame(spark, ids, M, "bank_id"),
                   exclude_self=True, group_bytes=200).toPandas().set_index("probe_id")
    D = M @ M.T
    np.fill_diagonal(D, -np.inf)
    assert np.allclose(mx.loc[ids, "max_dot"], D.max(axis=1))


def test_sparse_topk_pads_with_zero_score_lowest_ids(spark):
    probe_terms = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "zz", 1.0)],
                                        "probe_id long, term string, weight double")
    bank = spark.createDataFrame([(10, ["a"] * 2), (11, ["b"] * 6), (12, ["a"]), (13, ["c"] * 9), (14, []), (15, None)], "bank_id long, tokens array<string>")
    probe_ids = spark.createDataFrame([(1,), (2,), (3,)], "probe_id long")
    got = sparse_topk(probe_terms, bank.repartition(3), 3, lambda tf, dl: tf / 2, probe_ids=probe_ids, group_bytes=40).toPandas()
    r1 = got[got.probe_id == 1].sort_values("rank")
    assert list(r1.bank_id) == [11, 10, 12] and list(r1.score) == [3.0, 2.0, 1.0]
    r3 = got[got.probe_id == 3].sort_values("rank")
    assert list(r3.bank_id) == [10, 11, 12] and list(r3.score) == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_one_group_matches_brute_force(spark, metric):
    rng = np.random.default_rng(9)
    P = rng.normal(size=(15, 4)).round(1)
    B = rng.normal(size=(90, 4)).round(1)
    B[20] = B[50]
    pids, bids = np.arange(15), np.arange(90)
    bank = _frame(spark, bids, B, "bank_id").repartition(6)
    got = dense_topk(_frame(spark, pids, P, "probe_id"), bank, 6, metric=metric).toPandas()
    exp = _brute(P, B, pids, bids, 6, metric)
    for p, rows in exp.items():
        g = got[got.probe_id == p].sort_values("rank")
        assert list(g.bank_id) == [b for b, _ in rows]
        assert list(g["rank"]) == list(range(1, 7))
    both = np.vstack([P, B])
    ids = np.arange(105)
    got2 = dense_topk(_frame(spark, ids[:15], P, "probe_id"), _frame(spark, ids[:15], P, "bank_id").repartition(3),
                      2, metric=metric, exclude_self=True).toPandas()
    exp2 = _brute(P, P, ids[:15], ids[:15], 2, metric, exclude_self=True)
    for p, rows in exp2.items():
        assert list(got2[got2.probe_id == p].sort_values("rank").bank_id) == [b for b, _ in rows]
    assert both.shape[0] == 105


@pytest.mark.parametrize("group_bytes", [1 << 20, 60])
def test_odd_vectors_take_no_part(spark, group_bytes):
    nan, inf = float("nan"), float("inf")
    bank = spark.createDataFrame([(9, [nan, 1.0]), (10, [1.0, 0.0]), (11, None), (12, [0.0, 1.0]), (13, [inf, 0.0]), (14, [None, 1.0])],
                                 "bank_id long, vec array<double>")
    probes = spark.createDataFrame([(1, [1.0, 0.5]), (2, [-1.0, 1.0]), (3, None), (4, [nan, 0.0])], "probe_id long, vec array<double>")
    got = dense_topk(probes, bank, 3, group_bytes=group_bytes).collect()
    assert sorted((r.probe_id, r["rank"], r.bank_id) for r in got) == [(1, 1, 10), (1, 2, 12), (2, 1, 12), (2, 2, 10)]
    assert {(r.id, r.reason.split()[0]) for r in vector_violations(bank, "bank_id").collect()} == {(9, "null"), (11, "null"), (13, "null"), (14, "null")}
    n = dense_count_at_least(probes.withColumn("thr", F.lit(0.5)), bank, group_bytes=group_bytes).collect()
    assert sorted((r.probe_id, r.n_at_least, r.n_bank) for r in n) == [(1, 2, 2), (2, 1, 2)]
    assert dense_topk(probes.where("probe_id > 9"), bank, 3).count() == 0


def test_ragged_width_raises(spark):
    bank = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "bank_id long, vec array<double>")
    probes = spark.createDataFrame([(1, [1.0, 0.5])], "probe_id long, vec array<double>")
    with pytest.raises(Exception, match="width"):
        dense_topk(probes, bank, 1).collect()


def test_dot_products_are_pruned_by_norm(spark):
    from trainlens.plans.blocked_topk import pruned_cells
    rng = np.random.default_rng(11)
    P = rng.normal(size=(40, 6))
    B = rng.normal(size=(600, 6)) * np.exp(rng.normal(size=(600, 1)) * 1.5)  # spread norms
    B[300] = B[17]
    B[5:25] = 0
    pids, bids = np.arange(40), np.arange(600)
    probes, bank = _frame(spark, pids, P, "probe_id"), _frame(spark, bids, B, "bank_id").repartition(4)
    for k, exclude in ((5, False), (3, True)):
        exp = _brute(P, B, pids, bids, k, "dot", exclude)
        got = dense_topk(probes, bank, k, exclude_self=exclude, group_bytes=1500).collect()
        assert len(got) == 40 * k
        for r in got:
            assert exp[r.probe_id][r["rank"] - 1][0] == r.bank_id
    first, (left, _, cells) = pruned_cells(probes, bank, 5, group_bytes=1500)
    assert first.select("probe_id").distinct().count() == 40
    wanted = left.select("probe_id", "bucket").distinct().count()
    share = wanted / (40 * 25)
    assert cells > 50 and share < 0.2, share  # over four fifths of the (probe, bucket) pairs are skipped
    # more rows than a bank has, and rows that tie
    few = dense_topk(probes, bank.where("bank_id < 30"), 40, group_bytes=700).collect()
    exp = _brute(P, B[:30], pids, bids[:30], 40, "dot")
    assert len(few) == 40 * 30 and all(exp[r.probe_id][r["rank"] - 1][0] == r.bank_id for r in few)


def test_all_scores_and_their_ranks(spark):
    from trainlens.operators.attribution import influence_matrix
    rng = np.random.default_rng(12)
    P, B = rng.normal(size=(7, 3)).round(1), rng.normal(size=(90, 3)).round(1)
    frame = lambda M: spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(M)), "grad": list(M)})).repartition(3)
    exp = _brute(P, B, range(7), range(90), 90, "dot")
    got = influence_matrix(frame(P), frame(B)).collect()
    assert len(got) == 630 and all(exp[r.test_id][r["rank"] - 1][0] == r.train_id for r in got)


def test_nothing_passes_through_the_driver(spark):
    import inspect

    from trainlens.plans import blocked_topk
    text = inspect.getsource(blocked_topk)
    assert "toArrow" not in text and "sc.broadcast" not in text and "sparkContext.broadcast" not in text


def _plain_sparse(terms, bank, k, probes):
    out = {}
    for p in probes:
        score = {b: sum(w * toks.count(t) / (1 + len(toks)) for q, t, w in terms if q == p) for b, toks in bank}
        out[p] = sorted(score, key=lambda b: (-round(score[b], 9), b))[:k]
    return out


@pytest.mark.parametrize("cluster", [False, True])
def test_sparse_scores_are_pruned_by_block_maxima(spark, cluster):
    from trainlens.plans import blocked_topk as K
    rng = np.random.default_rng(5)
    langs = [[f"{g}{i}" for i in range(40)] for g in "abcd"]
    bank = [(i, [str(x) for x in rng.choice(langs[i % 4], int(rng.integers(0, 25)))]) for i in range(400)]
    bank += [(500, []), (501, ["c1"] * 30)]
    terms = [(p, t, float(w)) for p in range(20) for t, w in zip(rng.choice(langs[p % 4], 6, replace=False), rng.integers(1, 9, 6), strict=True)]
    terms += [(30, "nowhere", 1.0), (31, "a1", -2.0), (32, "b1", 3.0), (32, "c1", -1.0)]
    probes = [*range(20), 30, 31, 32, 33]  # 33 has no term at all
    df = spark.createDataFrame([(i, t, "abcd"[i % 4]) for i, t in bank], "bank_id long, tokens array<string>, cluster string").repartition(4)
    df = df if cluster else df.drop("cluster")
    frame = spark.createDataFrame(terms, "probe_id long, term string, weight double")
    ids = spark.createDataFrame([(p,) for p in probes], "probe_id long")
    weigh = lambda tf, dl: tf / (1 + dl)
    for k in (3, 8) if cluster else (3,):
        got = K.sparse_topk(frame, df, k, weigh, probe_ids=ids, group_bytes=1500, prune_from=2).collect()
        lists = {p: [r.bank_id for r in sorted((r for r in got if r.probe_id == p), key=lambda r: r["rank"])] for p in probes}
        assert lists == _plain_sparse(terms, bank, k, probes)
    # how many (probe, block) pairs of those with a list of positive scores are scored
    keyed = K._blocks_of(df, 30)
    rows = K._term_rows(ids, frame).withColumn("tile", F.lit(0))
    schema, arrow = K._types(ids, df)

    def scored(pairs):
        left = rows.join(pairs, "probe_id")
        right = keyed.withColumn("tile", F.lit(0)).select("bank_id", "tokens", "tile", F.col("block").alias("block"))
        return K._cells(left, right, 30, K._sparse_body(3, weigh, arrow), schema)
    _, rest = K.open_blocks(rows, keyed, 3, weigh, scored)
    mine = rest.where("probe_id < 20").count() + 20
    assert mine < (0.45 if cluster else 0.9) * 20 * keyed.select("block").distinct().count()


def _lambda_bodies(df):
    """The text of every lambda in the optimized plan."""
    text, out = df._jdf.queryExecution().optimizedPlan().toString(), []
    at = text.find("lambdafunction(")
    while at >= 0:
        end, depth = at + len("lambdafunction("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out.append(text[at:end])
        at = text.find("lambdafunction(", at + 1)
    return out


def test_row_values_are_not_computed_per_element(spark, tmp_dir):
    from trainlens.functions.vector import l2_normalize
    from trainlens.plans import blocked_topk as K
    from trainlens.sources.corpus import vector_samples
    rows = [(i, [float(i), 1.0, -2.0], i % 10) for i in range(5)] + [(5, None, 1), (6, [1.0, None, 2.0], 2), (7, [], 3), (8, [1.0, 2.0, 0.5], None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    s = vector_samples(spark, tmp_dir)
    bank = s.select(F.col("idx").alias("bank_id"), F.col("grad").alias("vec")).withColumn("norm", K._norm("vec"))
    for df in (s.select("idx", "grad"), s.select("idx", l2_normalize("grad")), bank.select("bank_id", K._above([2.0, 1.0, 0.5], "norm"))):
        bodies = _lambda_bodies(df)
        assert bodies and not any(x in b[len("lambdafunction("):].lower() for b in bodies for x in ("aggregate(", "exp(")), bodies
    got = {r.idx: r.grad for r in s.collect()}
    p = [1 / (1 + np.exp(-(-0.75 * i + 0.125 + 2 * 0.625))) for i in range(5)]
    assert all(np.allclose(got[i], (p[i] - 1.0) * np.array([i, 1.0, -2.0])) for i in range(5))
    assert got[5] is None and got[6] == [None] * 3 and got[7] == [] and got[8] == [None] * 3
    counts = spark.createDataFrame([(float(i),) for i in range(4)], "x double").select(K._above([2.5, 0.5], "x").alias("n")).collect()
    assert [r.n for r in counts] == [2, 1, 1, 0]


@pytest.mark.parametrize("exclude", [False, True])
def test_best_lists_look_closely_at_few_scores(exclude):
    from trainlens.plans import blocked_topk as K
    rng = np.random.default_rng(3)
    probes, ids = np.arange(300), rng.permutation(4000)
    scores = rng.normal(size=(300, 4000)).round(2)  # many ties
    scores[:5] = 0
    best, seen, round_ = K._Best(probes, 7, exclude), [], np.round
    try:
        K.np.round = lambda x, d: seen.append(np.size(x)) or round_(x, d)
        for s in range(0, 4000, 400):
            best.add(scores[:, s:s + 400], ids[s:s + 400])
    finally:
        K.np.round = round_
    for p in range(300):
        o = [j for j in np.lexsort((ids, -scores[p])) if not (exclude and ids[j] == p)][:7]
        assert list(best.ids[best.owner == p]) == list(ids[o])
    assert sum(seen) < scores.size / 5


def test_sparse_sides_are_packed_before_they_are_copied(spark, monkeypatch):
    from trainlens.plans import blocked_topk as K
    rng = np.random.default_rng(8)
    words = [f"word{i:03d}" for i in range(60)]
    bank = [(i, [str(x) for x in rng.choice(words, int(rng.integers(0, 90)), p=np.arange(60, 0, -1) / 1830)]) for i in range(200)]
    bank += [(300, []), (301, None), (302, ["word001", None])]
    terms = [(p, str(t), float(w)) for p in range(12) for t, w in zip(rng.choice(words, 40, replace=False), rng.integers(1, 9, 40), strict=True)]
    sides = []
    real = K._cells
    monkeypatch.setattr(K, "_cells", lambda left, right, *rest: sides.append((left, right)) or real(left, right, *rest))
    frame = spark.createDataFrame(terms, "probe_id long, term string, weight double")
    df = spark.createDataFrame(bank, "bank_id long, tokens array<string>").repartition(3)
    ids = spark.createDataFrame([(p,) for p in range(13)], "probe_id long")
    got = K.sparse_topk(frame, df, 4, lambda tf, dl: tf / (1 + dl), probe_ids=ids, group_bytes=8000).collect()
    lists = {p: [r.bank_id for r in sorted((r for r in got if r.probe_id == p), key=lambda r: r["rank"])] for p in range(13)}
    assert lists == _plain_sparse(terms, [(i, t or []) for i, t in bank], 4, range(13))
    left, right = sides[0]
    cells = left.select("tile", "block").distinct().count()
    # a row of a term or document for every cell would be thousands of them
    assert cells > 1 and left.count() < 60 and right.count() < 60


@pytest.mark.parametrize("repeat", [False, True])
def test_texts_are_joined_only_where_sample_ids_repeat(spark, tmp_dir, monkeypatch, repeat):
    from trainlens.catalog import attribution_q as Q
    from trainlens.operators import attribution as A
    from trainlens.sources.corpus import bank_texts, probe_texts, text_bank, text_probes
    docs = [(i, f"text {i} common", "s") for i in range(60)] + [(7, "again", "s"), (None, "no id", "s"), (61, None, "s")]
    vecs = [(i, [0.1, 0.2 * i], i % 10) for i in range(0, 40, 2)] + [(None, [1.0, 2.0], 1), (None, [1.0, 3.0], 1)]
    vecs += [(i, [0.5, 0.5], 2) for i in range(0, 30, 3) for _ in range(2)] if repeat else []
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_dir}/embeddings.parquet")
    rows = lambda df: sorted(map(tuple, df.select("idx", "text").collect()), key=str)
    assert rows(probe_texts(spark, tmp_dir)) == rows(text_probes(spark, tmp_dir))
    assert rows(probe_texts(spark, tmp_dir, "shadow")) == rows(text_probes(spark, tmp_dir, "shadow"))
    assert rows(bank_texts(spark, tmp_dir)) == rows(text_bank(spark, tmp_dir).where("has_text"))
    # what the queries rank by BM25
    seen, real = [], A.bm25_shortlist
    monkeypatch.setattr(A, "bm25_shortlist", lambda p, b, *rest: seen.extend((p, b)) or real(p, b, *rest))
    probes = {r.idx for r in probe_texts(spark, tmp_dir).collect()}
    for q in (Q.hybrid_topk, Q.influence_topk):
        assert {r.test_idx for r in q(spark, tmp_dir).collect()} == probes
    assert seen and repeat == any("Join" in df._jdf.queryExecution().optimizedPlan().toString() for df in seen)


def test_probe_terms_are_made_once(spark, monkeypatch):
    from trainlens.operators import lexical as L
    from trainlens.plans import blocked_topk as K
    counted, real = [], K._pieces
    monkeypatch.setattr(K, "_pieces", lambda df, *rest: counted.append(df.columns) or real(df, *rest))
    probes = spark.createDataFrame([(1, "a b b"), (2, None), (3, "zz")], "probe_id long, text string")
    docs = spark.createDataFrame([(10, "a a"), (11, "b c"), (12, None)], "bank_id long, text string")
    got = L.bm25_topk(probes, docs, 2).collect()
    assert sorted((r.probe_id, r["rank"], r.bank_id) for r in got)[2:] == [(2, 1, 10), (2, 2, 11), (3, 1, 10), (3, 2, 11)]
    assert not any("term" in c for c in counted), counted


def test_packed_sides_come_back_and_small_values_are_merged():
    import pyarrow as pa

    from trainlens.plans import blocked_topk as K
    rng = np.random.default_rng(2)
    t = pa.table({"sub": pa.array([0] * 8, pa.int32()), "probe_id": pa.array([70000, 5, 5, 9, 9, 70000, 9, 5]),
                  "term": ["b", "a", None, "b", None, None, "a", "c"], "weight": [1.5, 2.0, 0.0, 3.5, 0.0, 0.0, 2.0, -1.0]})
    got = K._unpack_terms(K._pack_terms(t).column("blob")[0].as_py())
    assert list(got.ids) == [5, 9, 70000] and got.dictionary.to_pylist() == ["a", "b", "c"]
    rows = [(got.ids[got.owner[i]], name, got.weight[i]) for n, name in enumerate("abc") for i in range(got.first[n], got.first[n + 1])]
    assert sorted(rows) == [(5, "a", 2.0), (5, "c", -1.0), (9, "a", 2.0), (9, "b", 3.5), (70000, "b", 1.5)]
    words = [f"w{i}" for i in range(300)]
    docs = {i: [str(x) for x in rng.choice(words, int(rng.integers(0, 40)))] for i in range(9000)}
    docs[8999] = ["w1"] * 70000
    blobs = []
    for a in range(0, 9000, 300):
        some = list(range(a, a + 300))
        batch = pa.RecordBatch.from_arrays([pa.array(some), pa.array([docs[i] for i in some]), pa.array([0] * 300, pa.int32())], ["bank_id", "tokens", "block"])
        blobs += [x.column(1)[0].as_py() for x in K._pack_docs(iter([batch]))]
    merged, back = list(K._merge_docs(iter(blobs))), {}
    assert len(blobs) == 30 and len(merged) == 3
    for raw in merged:
        ids, size, names, doc, term, tf = K._unpack_docs(raw)
        assert (np.diff(doc) >= 0).all() and list(size) == [len(docs[i]) for i in ids.to_pylist()]
        back |= {i: {} for i in ids.to_pylist()}
        for d, w, n in zip(doc, term, tf, strict=True):
            back[ids[int(d)].as_py()][names[int(w)].as_py()] = int(n)
    assert back == {i: {w: x.count(w) for w in set(x)} for i, x in docs.items()}


def test_grid_copies_few_bytes():
    from trainlens.plans import blocked_topk as K
    # one tile of 68 MB for six blocks: the large side is copied once
    assert K._grid(68, 576, 192, 6, 20) == (1, 6)
    assert K._grid(0, 0, 192, 1, 1) == (1, 1)
    rng = np.random.default_rng(4)
    for _ in range(200):
        left, right, cores, most = (int(x) for x in rng.integers([0, 0, 1, 1], [900, 9000, 40, 60]))
        tiles, blocks = K._grid(left, right, 192, cores, most)
        assert 1 <= tiles <= most and tiles * blocks >= cores
        assert tiles == most or left / tiles + right / blocks <= 192 + 1e-9
        even = max(1, -(-left // 96)), max(1, -(-right // 96))
        if tiles < most and even[0] <= most and even[0] * even[1] >= 4 * cores:
            assert left * blocks + right * tiles <= left * even[1] + right * even[0]


def test_few_cells_do_not_meet_in_a_partition(spark):
    from trainlens.plans import blocked_topk as K
    for tiles, blocks in ((1, 6), (2, 9), (1, 1)):
        n = K._apart(spark, tiles, blocks)
        grid = spark.range(tiles * blocks).select((F.col("id") / blocks).cast("int").alias("tile"), (F.col("id") % blocks).cast("int").alias("block"))
        assert grid.repartition(n, "tile", "block").select(F.spark_partition_id()).distinct().count() == tiles * blocks


def test_candidates_of_few_blocks_are_merged_at_once(spark):
    from trainlens.plans import blocked_topk as K
    rows = [(p, b, float((7 * p + 3 * b) % 11), b % 5) for p in range(6) for b in range(20)]
    local = spark.createDataFrame(rows, "probe_id long, bank_id long, score double, _src int")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert [exchanges(K._merge(local, 4, n)) for n in (5, K.MERGE, K.MERGE + 1, None)] == [1, 1, 2, 2]
    assert sorted(K._merge(local, 4, 5).collect()) == sorted(K._merge(local, 4).collect())


def test_probe_terms_are_counted_without_a_shuffle(spark):
    from trainlens.operators import lexical as L
    probes = spark.createDataFrame([(1, "a b B"), (2, None), (1, "a c"), (None, "c"), (4, "  "), (5, "zz zz")], "probe_id long, text string")
    counts = L.term_counts(probes.select("probe_id", L._tokens().alias("tokens")))
    assert sorted(map(tuple, counts.collect()), key=str) == sorted([(1, "a", 1), (1, "b", 2), (1, "a", 1), (1, "c", 1), (None, "c", 1), (5, "zz", 2)], key=str)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    # the rows of a repeated probe add up
    docs = spark.createDataFrame([(10, "a b"), (11, "c d"), (12, "e"), (13, "f g")], "bank_id long, text string")
    whole = spark.createDataFrame([(1, "a b b a c")], "probe_id long, text string")
    lists = [{(r.bank_id, r["rank"], round(r.score, 9)) for r in L.bm25_topk(x, docs, 4).collect()} for x in (probes.where("probe_id = 1"), whole)]
    assert lists[0] == lists[1] and len(lists[0]) == 4


def test_few_additions_are_held_at_once():
    import tracemalloc

    import pyarrow as pa

    from trainlens.plans import blocked_topk as K
    rng = np.random.default_rng(11)
    probe, docs, vocab, each = 500, 6000, 8000, 200
    held = np.stack([rng.choice(vocab, each, replace=False) for _ in range(probe)])
    terms = K._Terms(np.repeat(np.arange(probe), each), pa.array([f"t{x:04}" for x in held.ravel()]), rng.random(probe * each))
    term = np.concatenate([np.sort(rng.choice(terms.vocab, each, replace=False)) for _ in range(docs)])
    doc, w = np.repeat(np.arange(docs), each), rng.random(docs * each)
    best = K._Best(terms.ids, 5, False)
    tracemalloc.start()
    terms.score(best, np.arange(docs), doc, term, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak
    for p in (0, 123, 499):
        weight, at = np.zeros(terms.vocab), np.flatnonzero(terms.owner == p)
        weight[np.searchsorted(terms.first, at, side="right") - 1] = terms.weight[at]
        scores = np.bincount(doc, weight[term] * w, minlength=docs)
        order = np.lexsort((np.arange(docs), -np.round(scores, 9)))[:5]
        mine = best.owner == p
        assert list(best.ids[mine]) == order.tolist() and np.allclose(best.scores[mine], scores[order])


def test_many_probes_and_a_large_bank_are_not_copied(spark, monkeypatch):
    from trainlens.plans import blocked_topk as K
    rng = np.random.default_rng(8)
    words = [f"word{i:03d}" for i in range(60)]
    bank = [(i, [str(x) for x in rng.choice(words, int(rng.integers(0, 90)))]) for i in range(200)]
    bank += [(300, []), (301, None), (302, ["word001", None])]
    terms = [(p, str(t), float(w)) for p in range(12) for t, w in zip(rng.choice(words, 40, replace=False), rng.integers(1, 9, 40), strict=True)]
    frame = spark.createDataFrame(terms, "probe_id long, term string, weight double")
    df = spark.createDataFrame(bank, "bank_id long, tokens array<string>").repartition(5)
    ids = spark.createDataFrame([(p,) for p in range(13)], "probe_id long")  # 12 has no term
    monkeypatch.setattr(K, "SUB_BYTES", 4000)
    merged, real = [], K._merge
    monkeypatch.setattr(K, "_merge", lambda local, k, blocks=None: merged.append((local, blocks)) or real(local, k, blocks))
    weigh = lambda tf, dl: tf / (1 + dl)
    got = K.sparse_topk(frame, df, 4, weigh, probe_ids=ids, group_bytes=1 << 20, prune_from=1).collect()
    lists = {p: [r.bank_id for r in sorted((r for r in got if r.probe_id == p), key=lambda r: r["rank"])] for p in range(13)}
    assert lists == _plain_sparse(terms, [(i, t or []) for i, t in bank], 4, range(13))
    # both sides are written once, nothing is exchanged but k candidates of a probe and group
    (local, groups), = merged
    plan = local._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan, plan
    assert groups == 1 and local.count() == 13 * 4 * groups


def test_a_stream_of_cut_values_is_scored_whole(monkeypatch):
    import pyarrow as pa

    from trainlens.plans import blocked_topk as K
    rng = np.random.default_rng(3)
    bank = [[f"w{x}" for x in rng.integers(0, 40, int(rng.integers(0, 30)))] for _ in range(90)]
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array(bank[a:b], pa.list_(pa.string())), pa.array([0] * (b - a), pa.int32())], ["bank_id", "tokens", "block"])
    monkeypatch.setattr(K, "CUT", 100)
    monkeypatch.setattr(K, "PACK_BYTES", 1)
    cut = [r for x in K._pack_cut(iter([batch(0, 50), batch(50, 90)])) for r in x.to_pylist()]
    assert len(cut) > 4 and sum(r["last"] for r in cut) == 2 and all(len(r["docs0"]) <= 20 for r in cut)
    subs = []
    for sub in range(2):  # two values of terms may meet in a task
        t = [(p, f"w{x}", float(w)) for p in range(3 * sub, 3 * sub + 3) for x, w in zip(rng.choice(40, 8, replace=False), rng.integers(1, 9, 8), strict=True)]
        table = pa.table({"sub": pa.array([sub] * len(t), pa.int32()), "probe_id": [x[0] for x in t], "term": [x[1] for x in t], "weight": [x[2] for x in t]})
        subs.append((t, K._pack_terms(table).column("blob")[0].as_py()))
    rows = [(sub, raw if i == 0 else None, *r.values()) for i, r in enumerate(cut) for sub, (_, raw) in enumerate(subs)]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 6, pa.bool_()), strict=True)]
    stream = pa.RecordBatch.from_arrays(cols, ["sub", "probes", *K._parts(), "last"])
    arrow = pa.schema([("probe_id", pa.int64()), ("bank_id", pa.int64()), ("score", pa.float64()), ("_src", pa.int32())])
    monkeypatch.setattr(K, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 7)}))}))
    body = K._streamed_body(5, lambda tf, dl: tf / (1 + dl), arrow, 2)
    got = [r for x in body(iter([stream.slice(0, 3), stream.slice(3)])) for r in x.to_pylist()]
    assert {r["_src"] for r in got} == {3}
    for t, _ in subs:
        for p, want in _plain_sparse(t, list(enumerate(bank)), 5, sorted({x[0] for x in t})).items():
            assert [r["bank_id"] for r in got if r["probe_id"] == p] == want
