import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trainlens.operators import examples as X
from trainlens.operators import gates as G
from trainlens.operators import lengths as L
from trainlens.operators import vectors as V
from trainlens.sources import io


def test_examples_template_and_fallbacks(spark):
    df = spark.createDataFrame([("s1", "Do it", "ctx", "done", None), ("s2", "Q", "", None, "alt"),
                                ("s3", "Q", "", None, None)],
                               "sample_id string, instruction string, input string, output string, response string")
    ex = {r.sample_id: r for r in X.build_examples(df).collect()}
    assert ex["s1"].prompt == "### Instruction:\nDo it\n\nInput:\nctx\n\n### Response:\n"
    assert ex["s1"].text == ex["s1"].prompt + "done"
    assert ex["s2"].target == "alt" and ex["s2"].error is None
    assert "missing target answer" in ex["s3"].error


def test_padding_masks_zero_and_truncation(spark):
    df = spark.createDataFrame([("a", "one two three"), ("b", "w " * 10)], "sample_id string, text string")
    t = {r.sample_id: r for r in X.tokenize(df, 5, "max_length").collect()}
    assert t["a"].attention_mask == [1, 1, 1, 0, 0] and t["a"].input_ids[3:] == [0, 0]
    assert len(t["b"].input_ids) == 5 and t["b"].attention_mask == [1] * 5
    assert X.tensor_violations(X.tokenize(df, 5, "max_length"), "max_length", 5).count() == 0
    lens = {r.sample_id: r.seq_len for r in L.effective_length(X.tokenize(df, 5, "max_length")).collect()}
    assert lens == {"a": 3, "b": 5}


def test_gates_pass_and_fail(spark):
    runs = spark.createDataFrame(
        [(1, 120, 1.2, 0.6, 60.0, 2.0, 2048.0), (2, 20, 0.2, 0.6, 60.0, 2.0, 2048.0),
         (3, 120, 1.2, 5.1, 60.0, 2.0, 2048.0)],
        "run_id long, steps long, epochs_completed double, train_loss double, train_runtime double, "
        "train_steps_per_second double, train_tokens_per_second double")
    runs = runs.withColumn("timing_breakdown_s", F.create_map(F.lit("train"), F.col("train_runtime"))) \
               .withColumn("throughput", F.struct(F.col("train_steps_per_second").alias("steps_per_second"),
                                                  F.col("train_tokens_per_second").alias("tokens_per_second")))
    log = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.8), (1, 2, 0.6), (3, 0, 1.0), (3, 1, 5.1)],
                                "run_id long, step int, loss double")
    rep = G.gate_report(G.gate_checks(runs, G.loss_endpoints(log, ["step"])))
    overall = {r.run_id: r.passed for r in rep.where("check = 'overall'").collect()}
    assert overall == {1: True, 2: False, 3: False}
    failed3 = {r.check for r in rep.where("run_id = 3 AND NOT passed AND check <> 'overall'").collect()}
    assert failed3 == {"final_loss", "loss_trend"}


def test_json_key_audit(spark):
    docs = spark.createDataFrame([(1, json.dumps({"run_id": "r", "output_dir": "o"})), (2, "[1]")],
                                 "run_id long, params string")
    miss = G.json_key_audit(docs, "params", G.REQUIRED_PARAMS_KEYS, "params.json")
    assert miss.where("run_id = 1").count() == 3 and miss.where("run_id = 2").count() == 5


def test_json_dataset_readers(spark, tmp_dir):
    p = os.path.join(tmp_dir, "list.json")
    with open(p, "w") as f:
        json.dump([{"instruction": "a", "output": 1}, "bad", {"instruction": "c", "output": None}], f)
    recs, viol = io.read_json_dataset(spark, p)
    assert [r.ordinal for r in viol.collect()] == [1]
    got = {r.ordinal: r.record for r in recs.collect()}
    assert got[0]["output"] == "1" and got[2]["output"] == ""
    w = os.path.join(tmp_dir, "wrapped.json")
    with open(w, "w") as f:
        json.dump({"data": [{"text": "x"}]}, f)
    assert io.read_json_dataset(spark, w)[0].count() == 1
    bad = os.path.join(tmp_dir, "bad.json")
    with open(bad, "w") as f:
        json.dump({"rows": []}, f)
    assert io.read_json_dataset(spark, bad)[1].first().ordinal == -1


def test_manifest_scan(spark, tmp_dir):
    p = os.path.join(tmp_dir, "train.csv")
    with open(p, "w") as f:
        f.write("sample_id,source\ns1,a\n ,b\ns3,c\n")
    ok, viol = io.read_manifest(spark, p, "train")
    assert [r.sample_id for r in ok.orderBy("pos").collect()] == ["s1", "s3"]
    assert [r.line for r in viol.collect()] == [3]
    empty, _ = io.read_manifest(spark, os.path.join(tmp_dir, "missing.csv"), "test")
    assert empty.count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_manifest(spark, os.path.join(tmp_dir, "missing.csv"), "train")


def test_gram_on_many_partitions_and_full_ihvp(spark):
    rng = np.random.default_rng(1)
    G_ = rng.normal(size=(40, 6))
    Q = rng.normal(size=(5, 6))
    bank = spark.createDataFrame(pd.DataFrame({"idx": range(40), "grad": list(G_)})).repartition(5)
    probes = spark.createDataFrame(pd.DataFrame({"idx": range(100, 105), "grad": list(Q)}))
    gram, n = V.gram_matrix(bank, 6)
    assert n == 40 and np.allclose(gram, G_.T @ G_)
    got = V.ihvp_topk(probes, bank, 3, 6).toPandas()
    inv = np.linalg.inv(G_.T @ G_ / 40 + 0.01 * np.eye(6))
    S = Q @ inv @ G_.T
    for i, p in enumerate(range(100, 105)):
        exp = list(np.argsort(-S[i], kind="stable")[:3])
        assert list(got[got.probe_id == p].sort_values("rank").bank_id) == exp
    with pytest.raises(ValueError, match="unsupported influence mode"):
        V.InfluenceConfig(mode="dense_hessian").validate()


def test_pairs_compare_keys_and_required_metrics(spark):
    from trainlens.operators import gates as G
    rows = [(1, 1, 5, 0.5, 2.0, 1.0, ["a", "b"]), (1, 2, 5, 0.5, 2.1, 1.0, ["b", "a"]),      # order of keys doesn't matter
            (2, 1, 5, 0.5, 2.0, 1.0, ["a"]), (2, 2, 5, 0.5, 2.0, 1.0, ["a", "c"]),
            (3, 1, 5, 0.5, None, 1.0, ["a"]), (3, 2, 5, 0.5, 2.0, None, ["a"]),
            (4, 1, 5, 0.5, 2.0, 1.0, None), (4, 2, 6, 0.5, 2.0, 1.0, []),
            (5, 1, 5, 0.5, 2.0, 1.0, ["a"]), (6, 1, 1, 0.1, 1.0, 1.0, []), (6, 2, 1, 0.1, 1.0, 1.0, []), (6, 3, 1, 0.1, 1.0, 1.0, [])]
    runs = spark.createDataFrame(rows, "pair int, run int, steps int, train_loss double, train_steps_per_second double, epochs_completed double, keys array<string>")
    got = {r.pair: r for r in G.pair_reproducibility(runs, "pair", "run", params_col="keys").collect()}
    assert {p: r.status for p, r in got.items()} == {1: "paired", 2: "parameter_keys", 3: "metric_missing", 4: "paired", 5: "unpaired", 6: "ambiguous"}
    assert {p: r.reproducible for p, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: None, 6: None}
    assert got[2].keys_differ == ["c"] and got[3].metrics_missing == ["epochs_completed", "train_steps_per_second"]
    # a metric that is no column at all
    short = G.pair_reproducibility(runs.drop("epochs_completed"), "pair", "run").where("pair = 1").first()
    assert short.status == "metric_missing" and short.metrics_missing == ["epochs_completed"]
