import pytest
from pyspark.sql import functions as F

from trainlens.operators import normalize as N
from trainlens.plans.ordinal import prefix_sums, with_ordinal


def test_defaults(spark):
    df = spark.createDataFrame([(0, "do x", "ok", None, None, None), (1, "do y", "fine", "id-7", " src ", "mit")],
                               "k int, instruction string, output string, sample_id string, source string, license string")
    n = N.normalize_records(df, "my data", ["k"]).orderBy("k").collect()
    assert n[0].sample_id == "my-data-000000" and n[0].source == "my-data" and n[0].license == "unknown"
    assert n[1].sample_id == "id-7" and n[1].source == "src" and n[1].license == "mit"
    assert N.dataset_prefix("   ") == "dataset"


def test_blank_text_rejected_with_index(spark):
    df = spark.createDataFrame([(0, "a"), (1, "   ")], "k int, text string")
    n = N.normalize_records(df, "d", ["k"])
    with pytest.raises(ValueError, match="index 1"):
        N.assert_valid(n)
    with pytest.raises(ValueError, match="at least one row"):
        N.assert_valid(n.where("false"))


def test_duplicate_ids(spark):
    df = spark.createDataFrame([("a",), ("a",), (" ",)], "sample_id string")
    got = {(r.sample_id, r.reason) for r in N.duplicate_ids(df).collect()}
    assert got == {("a", "duplicate sample_id"), ("", "blank sample_id")}


def test_ordinal_and_grouped_prefix_sums(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).repartition(7)
    o = with_ordinal(df, [F.col("id")], n_partitions=4).collect()
    assert all(r.pos == r.id for r in o)
    p = prefix_sums(df.withColumn("one", F.lit(1)), [F.col("id")], ["one"], partition_by=["g"],
                    n_partitions=4).collect()
    assert all(r.cum_one == r.id // 3 + 1 for r in p)


def test_white_space_is_pythons(spark):
    from trainlens.functions.text import is_blank, strip, word_tokens
    space = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [None, "", *space, "".join(space), *[f"{c}A{c}b c{c}" for c in space], "​x", "a\x00b", "Ünï CÔDE"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", strip("t").alias("s"), is_blank("t").alias("b"), word_tokens("t").alias("w")).collect():
        t = texts[r.i]
        assert r.b == (t is None or not t.strip())
        if t is not None:
            assert r.s == t.strip() and r.w == t.lower().split(), repr(t)
