"""Substring and suffix-array dedup against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest

from trainlens.llm import substring_dedup, suffix_dedup
from trainlens.llm import windows as W

from .conftest import corpus, same

NO_ID = -(1 << 63)


def late_mask(rows, seqs, width):
    first = {}
    for (i, _), s in zip(rows, seqs, strict=True):
        for k in range(len(s) - width + 1):
            at = (NO_ID if i is None else i, k)
            w = s[k:k + width]
            first[w] = min(first.get(w, at), at)
    for (i, _), s in zip(rows, seqs, strict=True):
        gone = np.zeros(len(s), bool)
        for k in range(len(s) - width + 1):
            if first[s[k:k + width]] < (NO_ID if i is None else i, k):
                gone[k:k + width] = True
        yield gone


def brute_words(rows, width):
    seqs = [tuple(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    for (i, _), s, g in zip(rows, seqs, late_mask(rows, seqs, width), strict=True):
        kept = " ".join(w for w, x in zip(s, g, strict=True) if not x)
        yield i, len(s), int(g.sum()), hashlib.sha256(kept.encode()).hexdigest()


def brute_bytes(rows, width):
    seqs = [(t or "").encode() for _, t in rows]
    for (i, _), s, g in zip(rows, seqs, late_mask(rows, seqs, width), strict=True):
        kept = bytes(b for b, x in zip(s, g, strict=True) if not x)
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        yield i, len(s), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_words(spark, messy, crowd):
    """crowd=1 splits every recurring key into windows."""
    got = substring_dedup.dedup(messy, crowd=crowd, with_text=False).collect()
    same([tuple(r) for r in got], list(brute_words(corpus(), 20)))


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_bytes(spark, messy, crowd):
    got = suffix_dedup.dedup(messy, crowd=crowd, with_bytes=False).collect()
    same([tuple(r) for r in got], list(brute_bytes(corpus(), 100)))


def test_kept_text(messy):
    rows = substring_dedup.dedup(messy, carry=("lang",)).where("doc_id IN (9, 100, 104, 109)").collect()
    text = {r.doc_id: r for r in rows}
    assert text[104].kept_text == "aa bb cc" and text[104].n_removed == 0
    assert text[109].kept_text == "" and text[109].n_words == 0
    assert text[100].n_removed > 0 and "lang" in rows[0].asDict()


def test_empty(nothing):
    assert substring_dedup.dedup(nothing).count() == 0
    assert suffix_dedup.dedup(nothing).count() == 0


def test_long_text_in_pieces(monkeypatch):
    """Cutting a long text into pieces yields the same windows."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "bb", "ccc", "d" * 30]) for _ in range(3000)).encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    for sym in (W.Symbols(20, 5, W.word_pieces), W.Symbols(100, 32, W.byte_pieces)):
        def windows(step):
            monkeypatch.setattr(W.C, "PIECE_BYTES", step)
            out = set()
            for p in sym.pieces(buf, off, sym.width, sym.gram):
                st, n, _, _ = W.runs(p, sym.width, sym.gram)
                for a, k in zip(st.tolist(), n.tolist(), strict=True):
                    for j in range(a, a + k):
                        out.add((int(p.base[0]) + j, p.data[p.start[j]:p.end[j + sym.width - 1]]))
            return out
        assert windows(700) == windows(1 << 20)


def test_suffix_order_is_exact():
    rng = random.Random(5)
    for alphabet in (b"ab", b"abcdefgh", b"a"):
        runs = [bytes(rng.choice(alphabet) for _ in range(rng.randrange(12, 60))) for _ in range(40)]
        width = 10
        n = np.array([len(r) - width + 1 for r in runs])
        t = suffix_dedup.Text(runs, n, width)
        order = suffix_dedup.suffix_order(t)
        raw = t.bytes.tobytes()
        cut = [raw[i:i + width] for i in order.tolist()]
        assert cut == sorted(cut) and len(cut) == n.sum() and len(set(order.tolist())) == len(cut)
        lcp = suffix_dedup.common_prefixes(t, order)
        for a, b, got in zip(cut, cut[1:], lcp[1:].tolist(), strict=False):
            k = 0
            while k < width and a[k] == b[k]:
                k += 1
            assert k == got


def test_locate_matches_hash_sets():
    """One shard, few words, every window repeated somewhere."""
    rng = random.Random(9)
    texts = list({" ".join(rng.choice("xyz") for _ in range(rng.randrange(4, 9))).encode() for _ in range(60)})
    n = np.array([len(t.split()) - 2 for t in texts])
    doc, at = np.arange(len(texts)) * 3 % 50, np.zeros(len(texts), np.int64)
    got = substring_dedup.locate(3)(texts, np.zeros(len(texts), np.int64), doc, at, n)
    first, order = {}, []
    for i, t in enumerate(texts):
        w = t.split()
        for k in range(n[i]):
            order.append((tuple(w[k:k + 3]), (doc[i], k)))
            first[order[-1][0]] = min(first.get(order[-1][0], order[-1][1]), order[-1][1])
    assert got.tolist() == [first[w] < p for w, p in order]
