"""Near-dedup against all pairs, and graph components."""
import random
import re

import numpy as np
import pytest

from trainlens.llm import near_dedup
from trainlens.llm.graph import components

from .conftest import corpus, same

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    ids = [float("-inf") if i is None else i for i, _ in rows]
    for k, (i, _) in enumerate(rows):
        least = ids[k] if not sets[k] else min(ids[j] for j in range(len(rows)) if find(j) == find(k) and sets[j])
        yield i, len(sets[k]), None if least == float("-inf") else least, least == ids[k]


def test_components_of_documents(messy):
    got = near_dedup.dedup(messy).collect()
    same([tuple(r) for r in got], list(brute(corpus())))


def test_empty(nothing):
    assert near_dedup.dedup(nothing).count() == 0


@pytest.mark.parametrize("limits", [{"block_rows": 2}, {"big_bucket": 2}])
def test_blocks_and_big_buckets(spark, messy, limits):
    """Families cut into blocks, and buckets tied whole, give the same."""
    rows = near_dedup.describe(messy).checkpoint()
    base = near_dedup.linked_classes(messy, rows, percent=85, shards=3)
    if "big_bucket" in limits:
        fam = near_dedup.families(rows, shards=3, **limits)
        wide = {r.node: r.label for r in fam.collect()}
        for r in near_dedup.families(rows, shards=3).collect():
            assert wide[r.node] == wide[r.label]
    else:
        other = near_dedup.linked_classes(messy, rows, percent=85, shards=3, **limits)
        same([tuple(map(bytes, r)) for r in base.collect()], [tuple(map(bytes, r)) for r in other.collect()])


def test_recall_at_the_threshold():
    """Sets that just link meet in a table."""
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 340, dtype=np.uint64)
        x = np.concatenate([both, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])
        y = np.concatenate([both, rng.integers(0, 1 << 63, 30, dtype=np.uint64)])
        m = near_dedup.minhashes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        h = near_dedup.halves(m)
        eq = h[0] == h[1]
        met += eq[:near_dedup.HALVES].any() and eq[near_dedup.HALVES:].any()
    assert met == 300


def test_links_of_finds_all():
    rng = random.Random(2)
    base = [rng.randrange(1 << 40) for _ in range(100)]
    sets = [np.unique(np.array([rng.randrange(1 << 40) if rng.random() < p else b for b in base], np.uint64))
            for p in [0.0, 0.03, 0.05, 0.08, 0.12, 0.2, 0.5] for _ in range(8)]
    root = list(range(len(sets)))
    for i, r in near_dedup.links_of(sets, 85):
        root[i] = r
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            n = len(np.intersect1d(sets[a], sets[b]))
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = lambda x: {frozenset(i for i in range(len(x)) if x[i] == v) for v in x}
    assert groups(root) == groups(label)


def test_graph_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, x) for x in range(2, 60)]
    got = dict(components(spark.createDataFrame([*chain, *star, (7, 7), (900, 901), (901, 900)], "a long, b long")).collect())
    assert got[160] == 100 and got[59] == 1 and got[901] == 900 and len(got) == 61 + 59 + 2
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges_are_thinned_before_they_are_joined(spark):
    from trainlens.llm.graph import thinned
    # 300 nodes, each tied to 40 roots, and a small component with a loop
    edges = [(1000 + i, 10 + j) for i in range(300) for j in range(40)] + [(3, 2), (2, 3), (2, 1), (5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert thinned(df).count() <= 300 + 40 + 2
    got = {r.node: r.label for r in components(df).collect()}
    assert got == {**{1000 + i: 10 for i in range(300)}, **{10 + j: 10 for j in range(40)}, 1: 1, 2: 1, 3: 1}


def test_shards_tie_to_the_least_class():
    import pyarrow as pa
    sketch = bytes(near_dedup.SKETCH)
    names = [b"d", b"b", b"c", b"a"]
    t = pa.table({"key": pa.array([7] * 4), "cls": pa.array(names, pa.binary()), "sketch": pa.array([sketch] * 4, pa.binary())})
    assert sorted(near_dedup._ties(t).to_pylist(), key=lambda r: r["a"]) == [{"a": x, "b": b"a"} for x in (b"b", b"c", b"d")]
