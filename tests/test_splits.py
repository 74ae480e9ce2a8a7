import pytest
from pyspark.sql import functions as F

from trainlens.operators import splits as C
from trainlens.plans.ordinal import prefix_sums


def _records(spark, n):
    rows = [(f"sample-{i:05d}", "a" if i % 2 == 0 else "b", f"l{(i // 2) % 2}", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, source string, license string, text string") \
                .withColumn("ordinal", F.monotonically_increasing_id())


def _counts(df):
    return {r["split"]: r["n"] for r in C.split_summary(df).collect()}


def test_allocation_largest_remainder(spark):
    size = lambda n: spark.createDataFrame([(n,)], "n long")
    assert C.split_targets(size(100)) == {"train": 80, "test": 10, "shadow": 10}
    assert C.split_targets(size(5), {"train": 0.6, "test": 0.2, "shadow": 0.2}) == {"train": 3, "test": 1, "shadow": 1}
    assert C.split_targets(size(1).limit(0)) == {"train": 0, "test": 0, "shadow": 0}
    with pytest.raises(ValueError, match="sum to 1.0"):
        C.split_targets(size(10), {"train": 0.5, "test": 0.2, "shadow": 0.2})


def test_split_sizes_repeatable_and_disjoint(spark):
    df = _records(spark, 100)
    a = C.create_splits(df)
    assert _counts(a) == {"train": 80, "test": 10, "shadow": 10}
    first = sorted((r.sample_id, r.split) for r in a.select("sample_id", "split").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        second = sorted((r.sample_id, r.split) for r in C.create_splits(df).select("sample_id", "split").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first == second
    assert len({s for s, _ in first}) == 100


def test_subset_then_split(spark):
    df = _records(spark, 5000)
    sub = C.select_subset(df, 3000)
    assert sub.count() == 3000
    assert _counts(C.create_splits(sub)) == {"train": 2400, "test": 300, "shadow": 300}


def test_small_split_and_errors(spark):
    df = _records(spark, 5)
    assert _counts(C.create_splits(df, {"train": 0.6, "test": 0.2, "shadow": 0.2})) == {"train": 3, "test": 1, "shadow": 1}
    with pytest.raises(ValueError, match="must sum to the selected dataset size"):
        C.create_splits(_records(spark, 10), target_counts={"train": 5, "test": 1, "shadow": 1})
    with pytest.raises(ValueError, match=r"subset_size \(3000\) cannot exceed dataset size \(10\)"):
        C.select_subset(_records(spark, 10), 3000)


def _quotas(spark, sizes, targets):
    df = spark.createDataFrame([(f"{i:03d}", n) for i, n in enumerate(sizes)], "_k0 string, n long")
    rows = C.split_quotas(df, ("k",), C.RATIOS, targets).orderBy("_k0").collect()
    return [(r.q_train, r.q_test, r.q_shadow) for r in rows]


def test_quotas(spark):
    q = _quotas(spark, [7, 3, 11], {"train": 17, "test": 2, "shadow": 2})
    assert [sum(x) for x in q] == [7, 3, 11] and [sum(c) for c in zip(*q)] == [17, 2, 2]
    # tiny strata want train only; once it is used up the others take over
    q = _quotas(spark, [1] * 20, {"train": 16, "test": 2, "shadow": 2})
    assert q[:16] == [(1, 0, 0)] * 16
    assert [sum(c) for c in zip(*q)] == [16, 2, 2] and all(sum(x) == 1 for x in q)
    # most room first, then larger target, ratio, name
    assert q[16:18] == [(0, 1, 0), (0, 0, 1)]
    assert _quotas(spark, [5], {"train": 1, "test": 2, "shadow": 2}) == [(1, 2, 2)]


def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(10)], "id long, g string").withColumn("one", F.lit(1))
    got = prefix_sums(df, [F.col("id")], ["one"], partition_by=["g"], n_partitions=3).collect()
    assert sorted((r.id, r.cum_one) for r in got) == [(i, i // 2 + 1) for i in range(10)]


def test_texts_stay_out_of_the_numbering(spark):
    got = C.create_splits(_records(spark, 40))
    assert got.where("text = concat('text ', cast(substring(sample_id, 8, 5) as int))").count() == 40


def test_leak_check(spark):
    tr = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    te = spark.createDataFrame([("s1",)], "sample_id string")
    with pytest.raises(ValueError, match="overlap"):
        C.assert_disjoint(tr, te)
    C.assert_disjoint(tr, spark.createDataFrame([("s3",)], "sample_id string"))


def test_split_positions_and_first_n(spark):
    s = C.with_split_positions(C.create_splits(_records(spark, 100)))
    got = C.first_n_per_split(s, {"train": 5, "test": 2, "shadow": 1})
    assert _counts(got) == {"train": 5, "test": 2, "shadow": 1}
    pos = sorted(r.pos for r in s.where("split = 'test'").collect())
    assert pos == list(range(10))


def test_ids_must_be_unique(spark):
    df = _records(spark, 10)
    with pytest.raises(ValueError, match="unique"):
        C.create_splits(df.unionByName(df.limit(1)))
    with pytest.raises(ValueError, match="unique"):
        C.create_splits(df.withColumn("sample_id", F.when(F.col("sample_id") > "sample-00003", F.col("sample_id"))))


@pytest.mark.parametrize("few", [1, 5, 10_000])
def test_smallest_k_without_a_limit(spark, few):
    from trainlens.plans.selection import smallest_k
    df = spark.range(3000).withColumn("v", F.col("id") % 7).repartition(5)
    key = F.md5(F.col("id").cast("string"))
    order = [r.id for r in df.orderBy(key, "id").collect()]
    for k in (0, 1, 2, 1500, 2999, 3000, 5000):
        got = smallest_k(df, key, "id", k, few=few)
        assert got.columns == ["id", "v"] and sorted(r.id for r in got.collect()) == sorted(order[:k])
    # one key on many rows, and null keys, which come last
    same = spark.range(50).select(F.when(F.col("id") < 40, F.lit("a" * 32)).alias("h"), "id")
    assert smallest_k(same, F.col("h"), "id", 30, few=few).where("h IS NULL").count() == 0
    assert sorted(r.id for r in smallest_k(same, F.col("h"), "id", 30, few=few).collect()) == list(range(30))
    assert smallest_k(same, F.col("h"), "id", 45, few=few).where("h IS NULL").count() == 5


def test_running_sums_of_integers_and_doubles(spark):
    rows = [(i % 3, i, None if i % 5 == 0 else i, i / 4) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, i long, a int, b double").repartition(7)
    got = prefix_sums(df, ["i"], ["a", "b"], partition_by=["g"], n_partitions=5).collect()
    for r in got:
        mine = [x for x in rows if x[0] == r.g and x[1] <= r.i]
        assert r.cum_a == sum(x[2] or 0 for x in mine) and abs(r.cum_b - sum(x[3] for x in mine)) < 1e-9
