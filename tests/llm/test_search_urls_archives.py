"""Exact search, URL rules and archives."""
import math
import random
import zlib

import pytest

from trainlens.llm import knn_join, url_filters, warc

from .conftest import same


def vectors(seed=1, n=220, width=5):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) * (3 if i % 11 == 0 else 1) for _ in range(width)]) for i in range(n)]
    rows += [(500 + i, [0.5] * width) for i in range(60)]  # one vector many times
    rows += [(7, rows[7][1]), (None, [0.1] * width), (900, None), (901, [0.1, None, 0.2, 0.3, 0.4]), (902, [math.nan] * width), (903, [math.inf] * width)]
    return rows


def brute(rows, k, query):
    v = sorted({(i, tuple(math.floor(64 * x) for x in e)) for i, e in rows
                if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)})
    for q, x in v:
        if query(q):
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in v if i != q)[:k]
            yield from ((q, r + 1, i, -s) for r, (s, i) in enumerate(best))


@pytest.mark.parametrize("pivots,block", [(8, 50), (1, 10_000), (64, 7)])
def test_topk(spark, pivots, block):
    rows = vectors()
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, cell string, rank int")
    v = knn_join.clean(df)
    got = knn_join.topk(v, v.where("vec_id % 20 = 0"), pivots=pivots, block=block).collect()
    same([tuple(r) for r in got], list(brute(rows, 20, lambda i: i % 20 == 0)))


def test_topk_small_inputs(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    v = knn_join.clean(df)
    same([tuple(r) for r in knn_join.topk(v, v.where("vec_id % 20 = 0")).collect()], list(brute([tuple(r) for r in df.collect()], 20, lambda i: i % 20 == 0)))
    none = v.where("vec_id < 0")
    assert knn_join.topk(none, none).count() == 0 and knn_join.topk(v, none).count() == 0
    one = v.where("vec_id = 0")
    assert knn_join.topk(one, one).count() == 0
    with pytest.raises(ValueError, match="width"):
        bad = knn_join.clean(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
        knn_join.topk(bad, bad)


def test_far_data_is_not_sent(spark):
    """Two far clusters: queries in one get no group of the other."""
    rng = random.Random(2)
    rows = [(i, [100 * (i % 2 * 2 - 1) + rng.random(), rng.random()]) for i in range(400)]
    v = knn_join.clean(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    same([tuple(r) for r in knn_join.topk(v, v.where("vec_id % 20 = 0"), k=3, pivots=4).collect()], list(brute(rows, 3, lambda i: i % 20 == 0)))


URLS = ["http://a.net/x", "https://A.Example.NET/en/1?q=http://b.org/fr/", "http://example.net/en", "http://example.net", "http://xnet/",
        "ftp://example.com/de/a#f", "http://m.example.com/en/", "http://b.org/fr/x", "http://b.org/frx", "no scheme", "", None, "http:///de/",
        "http://a.net:80/", "http://a.net?x/", "http://c..net/p", "x://org/fr/", "http://é.NET/ÀB", "http://a.net./x", "http://a.net/x"]


def expected(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h) + len(p), v, h + p) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, verdict, rule = max(fits, default=(0, "allow", None))
    return host, path, rule, verdict


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "r"), (3, URLS[3], "r")], "page_id long, url string, rule string")
    got = url_filters.classify(df, url_filters.rules_frame(spark, url_filters.RULES)).collect()
    same([tuple(r) for r in got], [(r.page_id, *expected(r.url)) for r in df.collect()])
    assert url_filters.classify(df.limit(0), url_filters.rules_frame(spark, url_filters.RULES)).count() == 0
    assert {r.verdict for r in url_filters.classify(df, url_filters.rules_frame(spark, [])).collect()} == {"allow"}


def test_url_plan_stays_native(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filters.classify(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), url_filters.rules_frame(spark, url_filters.RULES))
    text = plan._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text and df.count() == 1


PAGES = [(1, "http://a/", "same"), (2, "http://b/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "x", ""), (5, "nl\r\nx", "é" * 3000), (None, "n", "same"),
         (6, "long", "z" * 500_000), (None, "u", "only null"), (-9, "neg", "same")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, leader string")
    got = [tuple(r) for r in warc.round_trip(df).collect()]
    most = {}
    for i, _, h in PAGES:
        most[h or ""] = max(most.get(h or "", -math.inf), -math.inf if i is None else i)
    exp = []
    for i, _, h in PAGES:
        m = most[h or ""]
        me = -math.inf if i is None else i
        exp.append((i, len((h or "").encode()), warc.digest((h or "").encode()), "response" if me == m else "revisit", None if me == m else int(m)))
    same(got, exp)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_min_revisit(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/warc-{random.random()}"
    warc.write(df, path, min_revisit=5, archive_bytes=100)
    files = spark.read.parquet(path)
    assert files.count() > 1 and files.select("path").distinct().count() == files.count()
    kinds = warc.resolve(warc.read(files)).groupBy("record_type").count().collect()
    assert dict(map(tuple, kinds)) == {"response": len(PAGES)}  # "same" has four bytes


def records(n=6):
    return [warc.record_bytes(i, f"http://x/{i}", b"body %d " % i * 50, warc.digest(b"body %d " % i * 50), None) for i in range(n)]


def ids(reading):
    return [int(r.headers["warc-page-id"]) for r in reading.records]


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("how", ["flip", "cut", "insert", "head", "tail"])
def test_salvage(gz, how):
    parts = [warc.member(r) if gz else r for r in records()]
    whole = warc.read_archive(b"".join(parts))
    assert ids(whole) == list(range(6)) and not whole.gaps
    start, stop = sum(map(len, parts[:2])), sum(map(len, parts[:3]))
    bad = parts[2]
    if how == "flip":
        k = bad.find(b"body") + 30 if not gz else len(bad) // 2
        data = b"".join(parts[:2]) + bad[:k] + bytes([bad[k] ^ 255]) + bad[k + 1:] + b"".join(parts[3:])
        lost, gap = [2], (start, stop)
    elif how == "cut":
        data = b"".join(parts[:2]) + bad[:len(bad) - 20] + b"".join(parts[3:])
        lost, gap = [2], (start, stop - 20)
    elif how == "insert":
        data = b"".join(parts[:2]) + b"junk\x1f\x8b\x08junk" + b"".join(parts[2:])
        lost, gap = [], (start, start + 11)
    elif how == "head":
        data = parts[0][5:] + b"".join(parts[1:])
        lost, gap = [0], (0, len(parts[0]) - 5)
    else:
        data = b"".join(parts)[:-9]
        lost, gap = [5], (sum(map(len, parts[:5])), len(data))
    got = warc.read_archive(data)
    assert ids(got) == [i for i in range(6) if i not in lost]
    assert [g[:2] for g in got.gaps] == [gap] and got.gaps[0][2]


def test_other_writers_members():
    """Several records in one member, and a member with a wrong checksum."""
    r = records()
    both = warc.member(r[0] + r[1])
    bad = bytearray(warc.member(r[2]))
    bad[-6] ^= 1
    got = warc.read_archive(both + bytes(bad) + warc.member(r[3]))
    assert ids(got) == [0, 1, 3] and len(got.gaps) == 1
    assert zlib.decompress(warc.member(r[0]), 31) == r[0]


def test_damage_inside_a_member():
    """One bad record of a sound member, with and without sound neighbours."""
    r = records()
    bad = r[1].replace(b"body 1", b"b0dy 1", 1)
    first = warc.member(r[0] + bad + r[2])
    got = warc.read_archive(first + warc.member(bad) + warc.member(r[3] + b"junk"))
    assert ids(got) == [0, 2, 3] and [x.offset for x in got.records] == [0, 0, len(first) + len(warc.member(bad))]
    assert [g[0] for g in got.gaps] == [0, len(first), got.records[2].offset] and "block digest" in got.gaps[0][2]
    assert str(len(r[0])) in got.gaps[0][2] and str(len(r[0] + bad)) in got.gaps[0][2]


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("how", ["cut", "checksum", "flip", "tail"])
def test_broken_member_of_several_records(how, level):
    """What decompresses of a broken member is kept, once, and what follows is found."""
    rng = random.Random(5)
    bodies = [bytes(rng.choices(range(256), k=3000)) for _ in range(6)]
    r = [warc.record_bytes(i, f"http://x/{i}", b, warc.digest(b), None) for i, b in enumerate(bodies)]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    whole = z.compress(b"".join(r[:5])) + z.flush()
    if how == "cut":  # the end is missing and another member follows
        data, lost = whole[:len(whole) - 2000] + warc.member(r[5]), {4}
    elif how == "checksum":
        data, lost = whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:] + warc.member(r[5]), set()
    elif how == "flip":
        k = whole.find(bodies[2][1000:1004]) if level == 0 else len(whole) // 2
        data, lost = whole[:k] + bytes([whole[k] ^ 255]) + whole[k + 1:] + warc.member(r[5]), {2}
    else:
        data, lost = whole[:-1000], {4, 5}
    got = warc.read_archive(data)
    if how == "flip" and level:  # codes behind the flip may be lost with it
        assert ids(got)[:2] == [0, 1] and ids(got)[-1] == 5 and 2 not in ids(got) and len(set(ids(got))) == len(ids(got))
    else:
        assert ids(got) == [i for i in range(6) if i not in lost]
    assert got.gaps and all(g[0] == 0 for g in got.gaps)


def test_records_without_digest_in_a_broken_member():
    plain = [b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: %d\r\nContent-Length: 4\r\n\r\nabc%d\r\n\r\n" % (i, i) for i in range(3)]
    whole = warc.member(b"".join(plain))
    assert ids(warc.read_archive(whole)) == [0, 1, 2]
    assert ids(warc.read_archive(whole[:-9])) == [0, 1, 2]  # all that comes out is as written
    assert ids(warc.read_archive(whole[:-6] + bytes([whole[-6] ^ 1]) + whole[-5:])) == []  # nothing vouches for it


def test_gaps_are_rows(spark):
    data = b"".join(warc.member(r) for r in records()) + b"garbage"
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"")), ("c", None)], "path string, content binary")
    rows = warc.read(df).collect()
    assert sorted(r.page_id for r in rows if r.gap_end is None) == list(range(6))
    gap = [r for r in rows if r.gap_end is not None]
    assert len(gap) == 1 and gap[0].offset == len(data) - 7 and gap[0].gap_end == len(data)


def test_reading_is_linear_in_the_archive(monkeypatch):
    """A member's decompressor is fed the member and one step more at most,
    however long the archive; members over a step, and damage, included."""
    rng = random.Random(9)
    bodies = [bytes(rng.randrange(256) for _ in range(n)) for n in (200, 3000, 90_000)]
    members = [warc.member(warc.record_bytes(i, "u", bodies[i % 3], warc.digest(bodies[i % 3]), None)) for i in range(150)]
    fed = []

    class Counting:
        def __init__(self, z):
            self.z, self.i = z, len(fed)
            fed.append(0)

        def decompress(self, part, *a):
            fed[self.i] += len(part)
            return self.z.decompress(part, *a)

        def __getattr__(self, name):
            return getattr(self.z, name)
    real = warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", lambda *a: Counting(real(*a)))
    totals = []
    for n in (50, 150):
        fed.clear()
        out = warc.read_archive(b"".join(members[:n]))
        assert len(out.records) == n and not out.gaps and [r.body for r in out.records[:3]] == bodies
        assert len(fed) == n and all(f <= len(m) + 2 * warc.STEP for f, m in zip(fed, members, strict=False))
        totals.append(sum(fed))
    assert totals[1] < 4 * totals[0]
    broken = bytearray(b"".join(members))
    broken[len(members[0]) + 500] ^= 0xFF
    assert len(warc.read_archive(bytes(broken)).records) == 149
