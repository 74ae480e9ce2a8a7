"""The pipeline's stages, each against a direct computation on its input."""
import hashlib
import re
import tempfile

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from trainlens.llm import quality_classifier

from .conftest import DOC_SCHEMA, corpus, same
from .test_near_dedup import brute
from .test_packing_and_tokens import check_places
from .test_quality import counts
from .test_repeats import brute_words

STAGE = dict(pipeline.STAGES)


@pytest.fixture(scope="module")
def sf(spark):
    d = tempfile.mkdtemp(prefix="tl-sf-")
    rows = corpus()
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def run_stage(spark, name, docs, sf):
    out = STAGE[name](spark, docs, sf)
    assert name == "packing" or out.columns == pipeline.COLUMNS
    path = tempfile.mkdtemp(prefix="tl-stage-") + "/out"
    out.write.parquet(path)
    return spark.read.parquet(path)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_kept", F.lit(1)).withColumn("part", F.lit("x"))
    out = run_stage(spark, "quality_rules", docs, sf)
    # too few labels to admit a cutoff: the base rule alone decides, row by row
    same(pairs(out), [(i, t) for i, t in corpus() if not counts(t)[-1]])

    before = out
    out = run_stage(spark, "quality_classifier", before, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {(r.doc_id, r.rid) for r in quality_classifier.classify(before, labels, row_keys=True).where("kept").collect()}
    keyed = before.select("doc_id", "text", pipeline.C.row_key("doc_id", "text").alias("rid")).collect()
    same(pairs(out), [(r.doc_id, r.text) for r in keyed if (r.doc_id, r.rid) in kept])

    # the next stage is tried on all rows, whatever the classifier thinks of them
    before = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in corpus()], DOC_SCHEMA).repartition(3)
    out = run_stage(spark, "near_dedup", before, sf)
    same(pairs(out), list({row for row, r in zip(corpus(), brute(corpus(), pipeline.NEAR_PERCENT), strict=True) if r[3]}))

    rows = pairs(out)
    cut = run_stage(spark, "substring_dedup", out, sf)
    expected = []
    texts = {}
    for (i, t), (_, n, gone, sha) in zip(rows, brute_words(rows, 20), strict=True):
        if gone < n or n == 0:
            expected.append((i, sha if gone else hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", t or "")).encode()).hexdigest()))
            texts[i] = (t or "") if not gone else None
    got = cut.select("doc_id", "text", "n_chars").collect()
    same([(r.doc_id, hashlib.sha256(" ".join(re.findall(r"[^\x20\x09-\x0D]+", r.text)).encode()).hexdigest()) for r in got], expected)
    assert all(r.n_chars == len(r.text) for r in got)

    packed = run_stage(spark, "packing", cut, sf).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in got)
    check_places(packed)


def test_near_dedup_stage_links_from_80_percent(spark, sf):
    rows = corpus()
    at = {p: [r[3] for r in brute(rows, p)] for p in (80, 85)}
    assert at[80] != at[85]  # some pair lies between
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA).repartition(3)
    out = run_stage(spark, "near_dedup", docs, sf)
    same(pairs(out), list({r for r, k in zip(rows, at[80], strict=True) if k}))


def test_rows_of_null_and_repeated_ids_have_their_own_verdicts(spark, sf):
    good = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(4)]
    near = [t + " end" for t in good]
    junk = "bad " * 40
    rows = [(None, good[0], "en"), (None, junk, "en"), (None, None, "en"), (7, good[1], "en"), (7, junk, "en"), (8, good[2], None), (8, junk, None)]
    out = run_stage(spark, "quality_rules", spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], DOC_SCHEMA), sf)
    same(pairs(out), [(None, good[0]), (7, good[1]), (8, good[2])])

    # near copies under null and under one doc_id; exact copies; blank texts are no copies of each other
    rows = [(None, good[0]), (None, near[0]), (1, good[0]), (None, good[1]), (5, good[2]), (5, near[2]), (5, near[2]), (6, good[2]),
            (9, good[3]), (9, good[3]), (5, ""), (5, " "), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC_SCHEMA).repartition(3)
    got = pairs(run_stage(spark, "near_dedup", docs, sf))
    mine = lambda i, *texts: sum((i, t) in got for t in texts)
    assert mine(None, good[0], near[0]) == 1 and mine(None, good[1]) == 1 and mine(5, good[2], near[2]) == 1 and mine(9, good[3]) == 1
    assert len(got) == 7 and {(5, ""), (5, " "), (None, None)} < set(got)


def test_classifier_verdicts_are_per_row(spark, sf, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in [(None, "clean a"), (None, "toxic a"), (3, "clean b"), (3, "toxic b")]], DOC_SCHEMA)
    real = quality_classifier.classify
    monkeypatch.setattr(quality_classifier, "classify", lambda d, labels, **kw: real(d, labels.limit(0), **kw).join(
        d.select(pipeline.C.row_key("doc_id", "text").alias("rid"), F.col("text").startswith("clean").alias("clean")), "rid")
        .withColumn("kept", F.col("clean")))
    same(pairs(run_stage(spark, "quality_classifier", docs, sf)), [(None, "clean a"), (3, "clean b")])


def test_run_and_empty(spark, sf):
    a, b = (pipeline.run(spark, sf) for _ in range(2))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    same([tuple(r) for r in a.select(*cols).collect()], [tuple(r) for r in b.select(*cols).collect()])
    empty = tempfile.mkdtemp(prefix="tl-sf-")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert pipeline.run(spark, empty).count() == 0


def test_stage_list():
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "substring_dedup", "packing"]
