"""MinHash near-dedup by tensored banding.

Texts are sets of distinct five-word shingles. Equal sets form one class by a
128-bit digest, so only one row per class goes on. A class gets two small
collections of ``HALVES`` values, each made of ``DEPTH`` minhashes; a table's
key is a pair of one value from each collection, so HALVES squared tables cost
2 * HALVES * DEPTH minhashes. Values that no other class has are dropped
before pairs are formed, which leaves most classes without any.

Classes that share a key are candidates. Inside a bucket they are compared on
a short sketch (one byte for each of ``SKETCH`` minhashes); those that agree in
half of it are tied together, and the ties' components are the families in
which links are looked for. Buckets over ``big_bucket`` are tied whole. In a
family all members are compared on their full sets, and what links is decided
there alone: 100 * intersection >= percent * union. Families over a size bound
are cut into blocks, and each pair of blocks is a group of its own, so no task
holds more than two blocks and no pair is left out.

Members whose shingles are too rarely shared within the family to link with
anything are set aside before the comparison (a shingle no other member has
cannot be in an intersection); this loses no link.

Defined results: a null, empty or blank text has no shingles, links with
nothing and is its own component; under five words the whole sequence is one
shingle; equal texts link; repeated rows share a component; of rows with a
null doc_id (before all others) component_id is null where such a row is the
smallest; kept tells doc_id = component_id, so of repeated rows all stay;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlens.llm import common as C
from trainlens.llm.graph import components

SHINGLE = 5
HALVES, DEPTH, SKETCH = 12, 3, 36
NO_ID = -(1 << 63)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20_011)
_XOR = _rng.integers(0, 1 << 63, 2 * HALVES * DEPTH, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, 2 * HALVES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, in turn, and offsets."""
    buf = LOWER[buf]
    s, e, wo = C.spans(buf, off)
    code, words = C.codes(buf, s, e)
    h = C.hashes(words)[code] if len(code) else np.zeros(0, np.uint64)
    g = C.grams(h, SHINGLE)
    sets, sizes = [], np.zeros(len(off) - 1, np.int64)
    for i, (a, b) in enumerate(zip(wo[:-1].tolist(), wo[1:].tolist(), strict=True)):
        if b - a >= SHINGLE:
            x = np.unique(g[a:b - SHINGLE + 1])
        elif b > a:
            x = C.grams(h[a:b], b - a) ^ np.uint64(b - a)
        else:
            continue
        sets.append(x)
        sizes[i] = len(x)
    o = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=o[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), o


def minhashes(x: np.ndarray, o: np.ndarray) -> np.ndarray:
    """One row of minhashes per non-empty set."""
    at = o[:-1][np.diff(o) > 0]
    out = np.zeros((len(at), len(_MUL)), np.uint64)
    if len(at):
        for i in range(len(_MUL)):
            out[:, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], at)
    return C.mix(out)


def halves(m: np.ndarray) -> np.ndarray:
    """The two collections: 2 * HALVES values per set, marked by their place."""
    k = np.arange(2 * HALVES, dtype=np.uint64)[None, :]
    v = np.zeros((len(m), 2 * HALVES), np.uint64) + k
    for j in range(DEPTH):
        v = C.mix(v * np.uint64(0x9E3779B97F4A7C15) + m[:, j::DEPTH])
    return v


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        buf, off = C.buffer_of(b.column(b.schema.get_field_index("text")))
        for lo, hi in C.pieces(off):
            x, o = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            size = np.diff(o)
            m = minhashes(x, o)
            full = size > 0
            cls = [xxhash.xxh3_128_digest(x[a:z].tobytes()) if z > a else None for a, z in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            v = np.zeros((len(size), 2 * HALVES), np.uint64)
            v[full] = halves(m)
            sk = np.zeros((len(size), SKETCH), np.uint8)
            sk[full] = (m[:, :SKETCH] & np.uint64(255)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 2 * HALVES, dtype=np.int32)), pa.array(C.signed(v.ravel())))
            sketch = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.arange(0, sk.size + 1, SKETCH, dtype=np.int32)), pa.py_buffer(sk.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("rid")).slice(lo, hi - lo), b.column(b.schema.get_field_index("doc_id")).slice(lo, hi - lo),
                 pa.array(size), pa.array(cls, pa.binary()), lists, sketch],
                ["rid", "doc_id", "n_shingles", "cls", "halves", "sketch"])


def _ties(t: pa.Table) -> pa.Table:
    """Ties inside the buckets of a shard, as (class, root): one row at most
    for each class of the shard."""
    key = t.column("key").to_numpy()
    name = t.column("cls").combine_chunks().dictionary_encode()
    name = pa.concat_arrays(name.chunks) if isinstance(name, pa.ChunkedArray) else name
    # numbered in order of their value: a root is then the least class of its
    # ties, in which shards that share members mostly agree
    by_value = pc.sort_indices(name.dictionary)
    number = np.empty(len(by_value), np.int64)
    number[by_value.to_numpy()] = np.arange(len(by_value))
    classes = name.dictionary.take(by_value)
    cls = number[name.indices.to_numpy(zero_copy_only=False)]
    sk = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    o = np.lexsort((cls, key)) if len(key) else np.zeros(0, np.int64)
    key, cls, sk = key[o], cls[o], sk[o]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else o
    like = (sk == sk[head]).sum(1) * 2 >= SKETCH
    root = np.arange(len(classes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def tie(a: int, b: int) -> None:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    near = np.unique(np.stack([cls[~new & like], cls[head[~new & like]]], 1), axis=0)
    for a, b in near.tolist():
        tie(a, b)
    # buckets in which someone is unlike the first are compared pair by pair
    edge = np.append(np.flatnonzero(new), len(key))
    odd = np.unique(np.searchsorted(edge, np.flatnonzero(~like), side="right") - 1)
    for b in odd.tolist():
        x, y = edge[b], edge[b + 1]
        if y - x < 3:
            continue
        part = sk[x:y]
        for i, r in spanning(lambda i, p=part: (p == p[i]).sum(1) * 2 >= SKETCH, y - x):
            tie(int(cls[x + i]), int(cls[x + r]))
    top = np.array([find(i) for i in range(len(root))], np.int64)
    tied = np.flatnonzero(top != np.arange(len(top)))
    return pa.table({"a": classes.take(pa.array(tied)), "b": classes.take(pa.array(top[tied]))})


def spanning(row, n: int) -> Iterator[tuple[int, int]]:
    """(member, root) for every member that is not the first of its component;
    ``row(i)`` is the mask of i's neighbours among ``n``."""
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            i = todo.pop()
            got = np.flatnonzero(row(i) & left)
            left[got] = False
            for j in got.tolist():
                yield j, root
            todo += got.tolist()


def links_of(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """(member, root) of the components of linked sets, all pairs compared."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if 100 * n >= percent * (size.sum() - n):
            yield 1, 0
        return
    of = np.repeat(np.arange(len(sets)), size)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    alive = np.ones(len(sets), bool)
    while True:
        keep = alive[of]
        df = np.bincount(code[keep], minlength=int(code.max()) + 1)
        shared = np.bincount(of[keep], weights=df[code[keep]] > 1, minlength=len(sets))
        still = alive & (100 * shared >= percent * size)
        if (still == alive).all():
            break
        alive = still
    who = np.flatnonzero(alive)
    if len(who) < 2:
        return
    keep = alive[of] & (df[code] > 1)
    place = np.cumsum(alive) - 1
    rows = place[of[keep]]
    _, cols = np.unique(code[keep], return_inverse=True)
    width = int(cols.max()) + 1
    common = np.zeros((len(who), len(who)), np.float32)
    step = max(256, (16 << 20) // len(who))  # columns at a time, 64 MB
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for a in range(0, width, step):
        x, y = np.searchsorted(cols, [a, a + step])
        m = np.zeros((len(who), min(step, width - a)), np.float32)
        m[rows[x:y], cols[x:y] - a] = 1
        common += m @ m.T
    total = size[who]
    linked = lambda i: 100 * common[i].astype(np.int64) >= percent * (total[i] + total - common[i].astype(np.int64))
    for j, root in spanning(linked, len(who)):
        yield int(who[j]), int(who[root])


def _verify(percent: int):
    def verify(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t.select(["grp", "cls"]), [("grp", "ascending"), ("cls", "ascending")]))
        grp = t.column("grp").to_numpy()
        cls = t.column("cls").to_pylist()
        buf, off = C.buffer_of(t.column("text"))
        edge = np.append(np.flatnonzero(np.append(True, grp[1:] != grp[:-1])), len(grp)) if len(grp) else np.zeros(1, np.int64)
        out: list[tuple[bytes, bytes]] = []
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            sets: list[np.ndarray] = []
            for lo, hi in C.pieces(off[a:b + 1]):
                x, so = shingle_sets(buf[off[a + lo]:off[a + hi]], off[a + lo:a + hi + 1] - off[a + lo])
                sets += [x[p:q] for p, q in zip(so[:-1].tolist(), so[1:].tolist(), strict=True)]
            if len(sets) > 1:
                out += [(cls[a + i], cls[a + j]) for i, j in links_of(sets, percent)]
        return pa.table({"a": pa.array([p[0] for p in out], pa.binary()), "b": pa.array([p[1] for p in out], pa.binary())})
    return verify


def describe(docs: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, class, halves and sketch of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", C.row_key("doc_id", "text"))
    return base.mapInArrow(_describe, "rid long, doc_id long, n_shingles long, cls binary, halves array<long>, sketch binary")


def families(rows: DataFrame, *, shards: int, big_bucket: int = 2000) -> DataFrame:
    """(node, label): classes that may link, with their family's label."""
    reps = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
    single = reps.select("cls", F.posexplode("halves").alias("i", "v"))
    again = single.groupBy("v").agg(F.count("*").alias("met")).where("met > 1")
    sides = (single.join(again, "v").groupBy("cls")
             .agg(F.collect_list(F.when(F.col("i") < HALVES, F.struct("v", "met"))).alias("l"),
                  F.collect_list(F.when(F.col("i") >= HALVES, F.col("v"))).alias("r"))
             .where("size(l) > 0 AND size(r) > 0"))
    # the tables of one left value share a shard, so that a class is tied once
    # for all of them, unless that would gather very many classes
    key = F.xxhash64("l.v", "r")
    keyed = (sides.select("cls", F.explode("l").alias("l"), "r").select("cls", "l", F.explode("r").alias("r"))
             .select(key.alias("key"), F.when(F.col("l.met") <= big_bucket, F.col("l.v")).otherwise(key).alias("place"), "cls"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("cls").alias("least")).where("n > 1")
    bucketed = keyed.join(sizes, "key")
    small = (bucketed.where(F.col("n") <= big_bucket).select("key", "place", "cls").join(reps.select("cls", "sketch"), "cls")
             .withColumn("shard", F.pmod("place", F.lit(shards)).cast("int"))
             .groupBy("shard").applyInArrow(_ties, "a binary, b binary"))
    big = bucketed.where((F.col("n") > big_bucket) & (F.col("cls") != F.col("least"))).select(F.col("cls").alias("a"), F.col("least").alias("b"))
    return components(small.union(big))


def linked_classes(docs: DataFrame, rows: DataFrame, *, percent: int, shards: int, block_rows: int = 512,
                   block_bytes: int = 16 << 20) -> DataFrame:
    """(node, label) over the classes that link with another."""
    fam = families(rows, shards=shards)
    one = rows.where("cls IS NOT NULL").groupBy(F.col("cls").alias("node")).agg(F.min("rid").alias("rid"))
    text = docs.select(C.row_key(F.col("doc_id").cast("long"), F.col("text")).alias("rid"), "text")
    # rows that are equal share a rid: one text of each is enough
    members = (fam.join(one, "node").join(text, "rid").groupBy("node", "label").agg(F.first("text").alias("text")))
    members = members.checkpoint()
    sizes = (members.groupBy("label").agg(F.count("*").alias("m"), F.sum(F.octet_length("text")).alias("bytes"))
             .select("label", F.when((F.col("m") <= 2 * block_rows) & (F.col("bytes") <= 2 * block_bytes), 1)
                     .otherwise(F.ceil(F.greatest(F.col("m") / block_rows, F.col("bytes") / block_bytes))).cast("int").alias("blocks")))
    placed = members.join(sizes, "label").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                         lambda k: F.xxhash64("label", F.least("mine", k), F.greatest("mine", k)))
    groups = (placed.select(F.col("node").alias("cls"), "text", "blocks", F.explode(others).alias("grp"))
              .withColumn("shard", F.pmod("grp", F.lit(shards)).cast("int")))
    edges = groups.groupBy("shard").applyInArrow(_verify(percent), "a binary, b binary")
    return components(edges)


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The described rows, and (cls, label) of the classes that link."""
    spark = docs.sparkSession
    C.prepare(spark)
    shards = 4 * C.shuffle_partitions(spark)
    rows = describe(docs).checkpoint()
    return rows, linked_classes(docs, rows, percent=percent, shards=shards).withColumnRenamed("node", "cls")


def survivors(docs: DataFrame, *, percent: int) -> DataFrame:
    """doc_id, rid and copies (rows equal to it, itself included) of one row per
    component: the one with the smallest doc_id, null first, then the smallest
    rid. Texts without shingles are each their own component."""
    rows, link = _linked(docs, percent)
    each = rows.groupBy("cls", "doc_id", "rid").agg(F.count("*").alias("copies"))
    first = F.struct("doc_id", "rid", "copies")
    least = each.where("cls IS NOT NULL").groupBy("cls").agg(F.min(first).alias("least"))
    one = least.join(link, "cls", "left").groupBy(F.coalesce("label", "cls")).agg(F.min("least").alias("least"))
    return one.select("least.*").unionByName(each.where("cls IS NULL").drop("cls"))


def dedup(docs: DataFrame, *, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, link = _linked(docs, percent)
    least = rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least"))
    root = (least.join(link, "cls", "left")
            .withColumn("label", F.coalesce("label", "cls")))
    comp = root.groupBy("label").agg(F.min("least").alias("component"))
    per_class = root.join(comp, "label").select("cls", "component")
    return (rows.select("doc_id", "n_shingles", "cls").join(per_class, "cls", "left")
            .withColumn("component", F.coalesce("component", "doc_id", F.lit(NO_ID)))
            .select("doc_id", "n_shingles", F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
                    (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("component")).alias("kept")))
