"""Fill-in-middle against plain Python, chunk summaries against brute force."""
import hashlib
import random

import numpy as np
import pytest

from trainlens.llm import fill_in_middle as M

from .conftest import DOC_SCHEMA, corpus, same


def expected(doc_id, text, plain_pct=10, spm_pct=20, seed="1", marks=M.SENTINELS):
    t = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(t)
    if not t or any(m in t for m in marks) or h[2] % 100 >= 100 - plain_pct:
        return doc_id, n, "plain", None, None, t, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = marks
    spm = h[3] % 100 < spm_pct
    out = s + t[b:] + p + t[:a] + m + t[a:b] if spm else p + t[:a] + s + t[b:] + m + t[a:b]
    return doc_id, n, "spm" if spm else "psm", a, b - a, out, t


def run(docs, **kw):
    out = M.transform(docs, **kw)
    marks = kw.get("sentinels", M.SENTINELS)
    return [tuple(r) for r in out.select("*", M.restore("output", "form", marks).alias("restored")).collect()]


def odd_texts():
    rng = random.Random(5)
    out = ["", "a", "<P", "<P>", "<", "x" * 20_000, "é" * 9_000, "😀" * 3_000, "<" * 9000 + "S>", "ab é<M " * 3000, "a\0b\0" * 40, "<<S" * 900]
    out += ["".join(rng.choice("ab<PSM>é漢😀 \n") for _ in range(rng.randrange(3000))) for _ in range(60)]
    return out + ["q" * k + "<S>" + "r" * 9000 for k in range(M.MAX_CHUNK - 8, M.MAX_CHUNK + 8)]


def test_transform(spark, messy, nothing):
    same(run(messy), [expected(i, t) for i, t in corpus()])
    odd = list(enumerate(odd_texts()))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], DOC_SCHEMA).repartition(3)
    same(run(docs), [expected(i, t) for i, t in odd])
    own = dict(plain_pct=0, spm_pct=100, seed="x", sentinels=("[1]", "[2]", "[3]"))
    same(run(docs, **own), [expected(i, t, 0, 100, "x", own["sentinels"]) for i, t in odd])
    assert run(nothing) == []


def test_summaries_with_a_full_cache():
    texts = odd_texts()
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    for cache in (M.Summaries(), M.Summaries(limit=2000)):
        for _ in range(2):
            n, marked, byte_at = M.cut_places(buf, off, cache)
            assert n.tolist() == [len(t) for t in texts]
            assert marked.tolist() == [any(m in t for m in M.SENTINELS) for t in texts]
            for i, t in enumerate(texts):
                at = np.array([0, len(t) // 3, max(0, len(t) - 1), len(t)])
                assert (byte_at(np.full(4, i), at) - off[i]).tolist() == [len(t[:p].encode()) for p in at]
        assert cache.size <= max(cache.limit, 0) and cache.size == sum(len(c) + 150 for c in cache.known)


def test_shared_passages_share_chunks():
    rng = random.Random(2)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(4000)).encode()
    raw = [b"x" * k + b" " + passage for k in range(5)]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
    cache = M.Summaries()
    starts = M.chunk_starts(buf, off)
    cache.of(buf, starts)
    assert len(cache.known) < len(starts) / 3
    size = np.diff(np.append(starts, len(buf)))
    last = np.isin(starts + size, off)
    assert (size[~last] >= M.MIN_CHUNK).all() and (size <= M.MAX_CHUNK + M.MIN_CHUNK).all()


def test_sentinels_that_cannot_be_told_apart():
    with pytest.raises(ValueError, match="sentinels"):
        M.Summaries(("aab", "<S>", "<M>"))
