"""Multiple-instance toxicity: slopes, a planted word, held-out accuracy."""
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trainlens.llm import toxicity as T

from .conftest import DOC_SCHEMA, corpus, same

SF = "/root/testdata/sf0.1"


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def test_sentences_against_plain_python():
    texts = ["", "One two. three!", "..\n\n", "É ü, x-y? Z", "a" * 50, "no end", " .a\r\nb. ", "x.", "漢字 word"]
    buf, off = buffer(texts)
    s = T.sentences(buf, off)
    expected = []
    for i, t in enumerate(texts):
        for piece in re.split(r"[.!?\n\r]", t):
            words = re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", piece)
            if words:
                expected.append((i, len(words), piece.encode().find(words[0].encode())))
    assert [(int(t), int(n) // 2) for t, n in zip(s.text, np.diff(s.first), strict=True)] == [x[:2] for x in expected]
    assert bytes(buf[s.start[0]:s.end[0]]) == b"One two" and bytes(buf[s.start[1]:s.end[1]]) == b"three"


def test_slopes():
    rng = np.random.default_rng(1)
    bag, label, plain = np.sort(rng.integers(0, 6, 20)), rng.random(6) < 0.5, rng.integers(0, 4, 6)
    z, h = rng.normal(size=20), 1e-6
    loss, slope, by_bias, by_leak = T.loss_and_slopes(z, -1.0, -2.0, bag, plain, label)
    at = lambda z, b, k: T.loss_and_slopes(z, b, k, bag, plain, label)[0]
    for i in range(20):
        assert abs((at(z + h * (np.arange(20) == i), -1.0, -2.0) - loss) / h - slope[i]) < 1e-4
    assert abs((at(z, -1.0 + h, -2.0) - loss) / h - by_bias) < 1e-4 and abs((at(z, -1.0, -2.0 + h) - loss) / h - by_leak) < 1e-4
    # the noisy-or itself
    p, leak, sig = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(2.0)), 1 / (1 + np.exp(1.0))
    whole = [1 - (1 - leak) * (1 - sig) ** plain[k] * np.prod(1 - p[bag == k]) for k in range(6)]
    assert abs(loss + np.mean([np.log(w if y else 1 - w) for w, y in zip(whole, label, strict=True)])) < 1e-9


def test_offending_sentences_are_located(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(300)}"
    rows, labels, truth = [], [], {}
    for i in range(400):
        body = [[word() for _ in range(6)] for _ in range(8)]
        if i % 4 == 0:
            k = int(rng.integers(8))
            body[k][3] = "Vile"
            truth[i] = " ".join(body[k])
        rows.append((i, ". ".join(" ".join(x) for x in body) + ".", None, None, None))
        labels.append((i, int(i % 4 == 0)))
    docs, marks = spark.createDataFrame(rows, DOC_SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.train(docs, marks.where(~T.held_out("doc_id")))
    got = T.offending(docs, model).collect()
    assert {r.doc_id: r.sentence for r in got} == truth and len(got) == len(truth)
    text = {r[0]: r[1] for r in rows}
    assert all(text[r.doc_id][r.start:r.start + r.length] == r.sentence for r in got)
    scored = T.score(docs, model).collect()
    assert all((r.score >= 0.7) == (r.doc_id in truth) == (r.n_offending > 0) and r.n_sentences == 8 for r in scored)


def test_odd_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9999, 1), (7, 1), (5, 0)], "doc_id long, toxic int")
    got = T.judge(messy, labels).collect()
    same([(r.doc_id,) for r in got], [(i,) for i, _ in corpus()])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    again = {}
    for r in got:  # repeated rows alike
        if r.doc_id in (12, 109):
            assert again.setdefault(r.doc_id, r) == r
    assert len({r.score for r in got if r.doc_id in (110, 111)}) == 1
    none = T.judge(messy, labels.limit(0)).collect()
    assert len(none) == len(got) and {(r.score, r.predicted) for r in none} == {(0.5, 0)}
    assert T.judge(nothing, labels).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return T.judge(docs, labels).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()


def test_held_out_accuracy(judged):
    held = [r for r in judged if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert len(toxic) > 50
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic) and sum(r.predicted for r in clean) < 0.01 * len(clean)
    ranks = np.argsort(np.argsort([r.score for r in held]))
    pos = np.array([r.toxic for r in held]) > 0
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95  # 2,650 training texts


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    other = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same([tuple(r) for r in T.judge(docs, labels).collect()], [tuple(r) for r in T.judge(docs, other).collect()])
