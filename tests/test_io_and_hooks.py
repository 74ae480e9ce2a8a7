import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trainlens.operators import attribution as A
from trainlens.operators import examples as X
from trainlens.operators import vectors as V
from trainlens.sources import io


def test_csv_reader_keeps_file_order_and_strings(spark, tmp_dir):
    p = os.path.join(tmp_dir, "d.csv")
    with open(p, "w") as f:
        f.write('sample_id,text,n\ns2,"multi\nline",3\ns1,b,\n')
    rows = io.read_csv_dataset(spark, p).orderBy("ordinal").collect()
    assert [r.sample_id for r in rows] == ["s2", "s1"]
    assert rows[0].text == "multi\nline" and rows[1].n == ""


def test_sinks_round_trip(spark, tmp_dir):
    splits = spark.createDataFrame([("a", "s", None, "train"), ("b", "t", "mit", "test")],
                                   "sample_id string, source string, license string, split string")
    io.write_manifests(splits, os.path.join(tmp_dir, "m"))
    back = spark.read.option("header", True).csv(os.path.join(tmp_dir, "m"))
    # an empty field reads back as null
    assert {(r.sample_id, r.split, r.license) for r in back.collect()} == {("a", "train", None), ("b", "test", "mit")}
    io.write_snapshot(splits, os.path.join(tmp_dir, "snap"))
    assert spark.read.json(os.path.join(tmp_dir, "snap")).count() == 2
    res = spark.createDataFrame([(1, "hybrid", 1, 5, 0.5), (1, "hybrid", 2, 6, 0.4)],
                                "test_idx long, method string, rank int, train_idx long, score double")
    summary = io.write_attribution(res, os.path.join(tmp_dir, "res")).collect()
    assert summary[0].n_rows == 2 and summary[0].top_k == 2
    assert spark.read.json(os.path.join(tmp_dir, "res", "json")).count() == 2
    m = res.select(F.col("test_idx").alias("test_id"), F.col("train_idx").alias("train_id"),
                   F.col("score").alias("influence_score"), "rank")
    io.write_influence(m, A.topk_map(m, 2), os.path.join(tmp_dir, "inf"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "inf", "influence_matrix")).count() == 2
    topk = spark.read.json(os.path.join(tmp_dir, "inf", "topk")).first()
    assert [e.train_id for e in topk.topk] == [5, 6]


def test_run_artifact_scan(spark, tmp_dir):
    for run, loss in (("r1", 0.5), ("r2", 0.7)):
        os.makedirs(os.path.join(tmp_dir, "runs", run, "train"))
        with open(os.path.join(tmp_dir, "runs", run, "train", "metrics.json"), "w") as f:
            json.dump({"train_loss": loss, "steps": 10, "throughput": {"steps_per_second": 1.0}}, f, indent=2)
    df = io.read_run_artifacts(spark, os.path.join(tmp_dir, "runs", "*", "train", "metrics.json"))
    assert {(r.run_id, r.train_loss) for r in df.collect()} == {("r1", 0.5), ("r2", 0.7)}


def test_manifest_resolution_paths(spark):
    corpus = spark.createDataFrame([(0, "i0", "", "o0"), (1, "i1", "x", "o1"), (2, "i1", "x", "o1")],
                                   "idx long, instruction string, input string, output string")
    by_col = spark.createDataFrame([("a", 1)], "sample_id string, row_id long")
    assert X.resolve_manifest(by_col, corpus).first().resolved_idx == 1
    by_digits = spark.createDataFrame([("dataset-000002",), ("x0",)], "sample_id string")
    assert sorted(r.resolved_idx for r in X.resolve_manifest(by_digits, corpus).collect()) == [0, 2]
    by_text = spark.createDataFrame([("q", " i1 ", "x", "o1"), ("r", "none", "", "z")],
                                    "sample_id string, instruction string, input string, output string")
    got = {r.sample_id: r.resolved_idx for r in X.resolve_manifest(by_text, corpus).collect()}
    assert got == {"q": 2, "r": None}  # duplicates: the last corpus row wins; unmatched -> null
    rec = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    man = spark.createDataFrame([("s1",), ("s9",)], "sample_id string")
    assert [r.sample_id for r in X.unknown_ids(man, rec).collect()] == ["s9"]
    with pytest.raises(ValueError, match="not present in original dataset: s9"):
        X.assert_known_ids(man, rec, "train")
    train = spark.createDataFrame([("s1", 0), ("s2", 1)], "sample_id string, pos long")
    pos = {r.sample_id: r.pos for r in X.subset_positions(man, train).collect()}
    assert pos == {"s1": 0, "s9": None}


def test_response_column_and_label_schema(spark):
    df = spark.createDataFrame([("s", "q", "a")], "sample_id string, instruction string, output string")
    ex = X.build_examples(df, with_response=True)
    assert ex.first().response == "a"
    assert X.label_schema_violations(ex, "lm_generate_labels") == []
    assert X.label_schema_violations(ex, "padding_requires_labels") != []
    assert X.label_schema_violations(ex.withColumn("labels", F.array()), "lm_generate_labels") != []


def test_user_hooks(spark):
    df = spark.createDataFrame([("a", "x y z"), ("b", "q")], "sample_id string, text string")

    def enc(texts, max_len):
        return [[len(w) for w in t.split()][:max_len] for t in texts]
    got = {r.sample_id: r.input_ids for r in X.tokenize_with(df, enc, 2).collect()}
    assert got == {"a": [1, 1], "b": [1]}
    vec = spark.createDataFrame(pd.DataFrame({"idx": [1, 2], "x": [1.0, 2.0]}))
    g = V.gradients_with(vec, lambda pdf: (np.c_[pdf.x, 2 * pdf.x], pdf.x ** 2), 2).orderBy("idx").collect()
    assert list(g[1].grad) == [2.0, 4.0] and g[1].loss == 4.0


def test_case_study_probes_through_all_methods(spark):
    rng = np.random.default_rng(11)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    bank = pd.DataFrame({"idx": range(20),
                         "text": [" ".join(rng.choice(words, 6)) for _ in range(20)],
                         "vec": list(rng.normal(size=(20, 3))), "grad": list(rng.normal(size=(20, 3)))})
    probe = pd.DataFrame({"idx": [100], "text": ["alpha beta alpha"], "vec": [np.ones(3)], "grad": [np.ones(3)]})
    r = A.attribute_all(spark.createDataFrame(probe), spark.createDataFrame(bank),
                        A.AttributionConfig(top_k=3, shortlist_n=8)).toPandas()
    assert sorted(r.method.unique()) == ["gradient_cosine", "hybrid", "influence"]
    assert (r.groupby("method").size() == 3).all()


def test_rows_of_several_files_keep_path_order(spark, tmp_dir):
    """A later, larger file must not come first."""
    for name, n in (("a.csv", 3), ("b.csv", 500), ("c.csv", 2)):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("k\n" + "".join(f"{name}-{i}\n" for i in range(n)))
    for multi_line in (True, False):
        rows = io.read_csv_dataset(spark, tmp_dir, multi_line=multi_line).orderBy("ordinal").collect()
        assert [r.ordinal for r in rows] == list(range(505))
        assert [r.k for r in rows[:4]] == ["a.csv-0", "a.csv-1", "a.csv-2", "b.csv-0"] and rows[-1].k == "c.csv-1"


def test_corrupt_json_lines_are_violations(spark, tmp_dir):
    p = os.path.join(tmp_dir, "d.jsonl")
    with open(p, "w") as f:
        f.write('{"text": "a", "n": 1}\nnot json\n{"text": null}\n')
    recs, bad = io.read_jsonl_dataset(spark, p)
    assert [(r.ordinal, r.text, r.n) for r in recs.orderBy("ordinal").collect()] == [(0, "a", "1"), (2, "", "")]
    assert [(r.ordinal, r.reason) for r in bad.collect()] == [(1, "Invalid dataset row at index 1: row must be a JSON object")]


def test_empty_train_manifest_raises(spark, tmp_dir):
    p = os.path.join(tmp_dir, "train.csv")
    with open(p, "w") as f:
        f.write("sample_id\n")
    with pytest.raises(ValueError, match="no rows"):
        io.read_manifest(spark, p, "train")
    assert io.read_manifest(spark, p, "test")[0].count() == 0


def test_unresolved_manifest_rows(spark):
    corpus = spark.createDataFrame([(0, "i0", "o0"), (1, "i1", "o1")], "idx long, instruction string, output string")
    got = X.resolve_manifest(spark.createDataFrame([("a", "1"), ("b", "x"), ("c", "9")], "sample_id string, row_id string"), corpus)
    assert {(r.sample_id, r.reason) for r in X.unresolved_rows(got, ["instruction"]).collect()} == {("b", "no corpus index"), ("c", "no corpus row")}
    with pytest.raises(ValueError, match="'b' could not be resolved"):
        X.assert_resolved(got, ["instruction"])
    X.assert_resolved(got.where("sample_id = 'a'"), ["instruction"])


def test_fingerprints_differ_where_xor_cancels(spark):
    fp = lambda *rows: X.dataset_fingerprint(spark.createDataFrame(rows, "a string, b string")).first()
    x, y = fp(("A", "1"), ("A", "1")), fp(("B", "2"), ("B", "2"))
    assert x.xor_hash == y.xor_hash and x.sum_hash != y.sum_hash
    assert fp((None, "x")) != fp(("", "x")) and fp(("p\x1fq", "r")) != fp(("p", "q\x1fr"))


def test_null_labels(spark):
    df = spark.createDataFrame([("a", [1]), ("b", None)], "sample_id string, labels array<int>")
    assert [r.sample_id for r in X.null_label_violations(df).collect()] == ["b"]
