"""Tree hashes, the digest tree with partial reuse, the transactional store."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from trainlens.operators import examples as X
from trainlens.operators import gates as G
from trainlens.sources import gradient_store as S


def put(root, run, name, data):
    p = os.path.join(root, run, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as f:
        f.write(data)


def test_tree_hash_names_the_first_differing_range(spark, tmp_dir):
    root = os.path.join(tmp_dir, "runs")
    big = bytes(i * 7 % 251 for i in range(100_000))
    other = bytearray(big)
    other[70_001] ^= 1
    for run, data in (("a", big), ("b", bytes(other)), ("c", big + b"tail")):
        put(root, run, "model/big.bin", data)
        put(root, run, "small.txt", b"same")
        put(root, run, "empty", b"")
    put(root, "a", "only.txt", b"x")
    leaves = G.artifact_leaves(spark, root, leaf_bytes=64).checkpoint()
    assert leaves.where("relpath = 'model/big.bin' AND run = 'a'").count() == -(-len(big) // 64)
    hashes = G.tree_hashes(leaves).checkpoint()
    got = {(r.run, r.relpath): r for r in hashes.collect()}
    assert got["a", "small.txt"].sha256 == hashlib.sha256(b"same").hexdigest() and got["a", "empty"].sha256 == hashlib.sha256(b"").hexdigest()
    level = [hashlib.sha256(big[i:i + 64]).hexdigest() for i in range(0, len(big), 64)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i:i + G.FAN]).encode()).hexdigest() if len(level[i:i + G.FAN]) > 1 else level[i] for i in range(0, len(level), G.FAN)]
    assert got["a", "model/big.bin"].sha256 == level[0] and got["a", "model/big.bin"].bytes == len(big)
    cmp = {r.relpath: r for r in G.compare_artifacts(hashes, "a", "b", leaves).collect()}
    assert not cmp["model/big.bin"].match and (cmp["model/big.bin"].first_offset, cmp["model/big.bin"].first_length) == (70_001 // 64 * 64, 64)
    assert cmp["small.txt"].match and cmp["empty"].match and cmp["small.txt"].first_offset is None
    assert not cmp["only.txt"].match and cmp["only.txt"].first_offset is None
    longer = {r.relpath: r for r in G.compare_artifacts(hashes, "a", "c", leaves).collect()}["model/big.bin"]
    assert not longer.match and longer.first_offset == len(big) // 64 * 64


def test_one_changed_row_rebuilds_one_bucket(spark, tmp_dir):
    path = os.path.join(tmp_dir, "cache")
    rows = [(f"k{i}", i, f"text {i}") for i in range(500)]
    seen = []

    def frame(rows):
        return spark.createDataFrame(rows, "key string, n long, text string").repartition(4)

    def build(df):
        seen.append(df.count())
        return df.select("key", F.upper("text").alias("t"), (F.col("n") * 2).alias("m"))

    def refresh(rows, **kw):
        seen.clear()
        out = X.cached_by_bucket(frame(rows), path, "key", build, buckets=32, **kw)
        return sorted(map(tuple, out.select("key", "t", "m").collect())), max(seen, default=0)

    def full(rows):
        return sorted((k, t.upper(), 2 * n) for k, n, t in rows)
    got, built = refresh(rows)
    assert got == full(rows) and built == 500
    got, built = refresh(rows[::-1])
    assert got == full(rows) and built == 0
    one = [(k, n, t + "!" if n == 77 else t) for k, n, t in rows]
    got, built = refresh(one)
    size = frame(rows).where(X._bucket("key", 32) == frame(one).where("n = 77").select(X._bucket("key", 32)).first()[0]).count()
    assert got == full(one) and built == size < 50
    less = [r for r in one if r[1] != 5] + [("new", 900, "n")]
    assert refresh(less)[0] == full(less)
    assert refresh(less, settings="v2") == (full(less), 500)
    # a manifest that was not finished is not read
    os.makedirs(os.path.join(path, "manifest-000099"))
    assert sorted(map(tuple, X.read_by_bucket(spark, path).select("key", "t", "m").collect())) == full(less)
    assert refresh([])[0] == []
    with pytest.raises(FileNotFoundError):
        X.read_by_bucket(spark, os.path.join(tmp_dir, "none"))


def test_digest_tree(spark):
    a = spark.createDataFrame([(i, f"t{i}") for i in range(200)], "key long, t string")
    tree = lambda df: {(r["level"], r.node): r.digest for r in X.digest_tree(X.bucket_digests(df, "key")).collect()}
    x, y = tree(a), tree(a.withColumn("t", F.when(F.col("key") == 9, "other").otherwise(F.col("t"))))
    assert x == tree(a.repartition(7)) and max(x)[0] == 2
    differ = sorted(k for k in x if x[k] != y[k])
    assert [k[0] for k in differ] == [0, 1, 2]  # one leaf, its parent, the root


def _train(spark, n=300, width=6):
    rows = [(i, [float((i * 31 + j) % 17) - 8 for j in range(width)], i / 7) for i in range(n)]
    return spark.createDataFrame(rows, "idx long, grad array<double>, loss double").repartition(5), {r[0]: r for r in rows}


def test_store_round_trip_and_pruning(spark, tmp_dir):
    train, rows = _train(spark)
    path = os.path.join(tmp_dir, "store")
    m = S.write_gradient_store(train, path, k=130, coords=[4, 0, 9], tensors=[("w", 4), ("b", 2)], chunk_rows=32)
    assert (m["rows"], m["width"], m["dtype"], m["value_bytes"], [t["name"] for t in m["tensors"]]) == (130, 3, "float32", 130 * 3 * 4, ["w", "b"])
    assert [(c["first"], c["rows"]) for c in m["chunks"]] == [(0, 32), (32, 32), (64, 32), (96, 32), (128, 2)] and all(c["written"] for c in m["chunks"])
    got = S.read_gradient_store(spark, path).orderBy("pos").collect()
    order = [r.idx for r in train.orderBy(F.md5(F.concat(F.lit("2026:"), F.col("idx").cast("string"))), "idx").limit(130).collect()]
    assert [r.idx for r in got] == order and [r.pos for r in got] == list(range(130))
    assert all(list(r.grad) == [rows[r.idx][1][4], rows[r.idx][1][0], 0.0] and abs(r.loss - rows[r.idx][2]) < 1e-12 for r in got)
    part = S.read_gradient_store(spark, path, 40, 30)
    assert [r.pos for r in part.orderBy("pos").collect()] == list(range(40, 70)) and len(part.inputFiles()) == 2


def test_a_dead_run_leaves_no_store_and_is_resumed(spark, tmp_dir):
    train, _ = _train(spark)
    path = os.path.join(tmp_dir, "store")
    kw = dict(k=100, coords=[0, 1], chunk_rows=25)

    def broken(df):
        # the rows of one chunk cannot be made
        bad = sorted(r.idx for r in train.orderBy(F.md5(F.concat(F.lit("2026:"), F.col("idx").cast("string"))), "idx").limit(60).collect()[55:])[0]
        return df.withColumn("loss", F.when(F.col("idx") == bad, F.raise_error(F.lit("no gradient"))).otherwise(F.col("loss")))
    with pytest.raises(Exception, match="no gradient"):
        S.write_gradient_store(train, path, grads=broken, **kw)
    with pytest.raises(FileNotFoundError, match="no committed"):
        S.read_gradient_store(spark, path)
    assert not [f for f in os.listdir(path) if f.startswith(".chunk")]
    left = {f for f in os.listdir(path) if f.startswith("chunk")}
    m = S.write_gradient_store(train, path, **kw)
    assert {c["file"] for c in m["chunks"] if not c["written"]} == left and len(left) < 4
    assert S.read_gradient_store(spark, path).count() == 100
    # lose one chunk: only that one is written again
    os.remove(os.path.join(path, m["chunks"][2]["file"]))
    again = S.write_gradient_store(train, path, **kw)
    assert [c["written"] for c in again["chunks"]] == [False, False, True, False]
    # other settings are another plan
    assert all(c["written"] for c in S.write_gradient_store(train, path, k=100, coords=[1], chunk_rows=25)["chunks"])
    assert S.write_gradient_store(train.limit(0), os.path.join(tmp_dir, "none"), **kw)["chunks"] == []
