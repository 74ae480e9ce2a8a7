"""Phrase collocations against plain Python counting, transducers by round trip."""
import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trainlens.llm import phrase_mining as P

from .conftest import DOC_SCHEMA, corpus, same


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, max_words=3, min_count=10, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    gone = {(p[0], *p[i:i + k]) for p, a in cand.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1)
            if 100 * a >= 50 * cand[(p[0], *p[i:i + k])]}
    out = collections.defaultdict(list)
    for p, a in cand.items():
        if p not in gone:
            score, _, x, y = min((10**6 * a * a // (f[p[:k + 1]] * f[(p[0], *p[k + 1:])]), k, f[p[:k + 1]], f[(p[0], *p[k + 1:])]) for k in range(1, len(p) - 1))
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), x, y))
    return [(lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, best in out.items() for r, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]


def run(docs, **kw):
    return [tuple(r) for r in P.mine(docs, **kw).collect()]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(k, t, lang, None, None) for k, (lang, t) in enumerate(rows)], DOC_SCHEMA).repartition(parts)


def odd_rows():
    rng = random.Random(7)
    alphabet = ["a", "b", "c", "A", "é", "the", "x\0y", "=", "漢", "w" * 100, "w" * 99 + "v"]
    rows = []
    for _ in range(300):
        t = "".join(rng.choice(alphabet) + rng.choice([" ", " ", "  ", "\t", " ", ". ", "\n", "\x0b", ""]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice([None, "und", "en", "fr en", "", "\n", "d"]), t))
    return rows + [("en", None), (None, None), ("en", ""), ("en", " . "), ("en", "the of " * 3000), ("long", "x " * 9), ("long", "y z. " * 10)]


def test_messy_corpus(spark, messy, nothing):
    langs = [None, "en", "fr"]
    same(run(messy, min_count=3), brute([(langs[k % 3], t) for k, (_, t) in enumerate(corpus())], min_count=3))
    assert run(nothing) == []


@pytest.mark.parametrize("kw", [{}, {"range_bytes": 600, "shard_words": 500}, {"range_bytes": 100, "shard_words": 10**6}])
def test_odd_texts_in_many_ranges(spark, kw):
    rows = odd_rows()
    same(run(frame(spark, rows), **kw), brute(rows))


def test_other_sizes_and_limits(spark):
    rows = odd_rows()
    same(run(frame(spark, rows), max_words=5, min_count=4, range_bytes=2000), brute(rows, 5, 4))
    same(run(frame(spark, rows), max_words=2, top=3, range_bytes=2000), brute(rows, 2, top=3))


def test_ranges_cut_a_frequent_phrase(spark):
    rows = [("en", " ".join(f"the big w{(i * 7 + j) % 90}" for j in range(200))) for i in range(40)]
    docs = frame(spark, rows).select("doc_id", "lang", "text")
    bounds = P.range_bounds(docs, 3, 2000)
    assert sum(b[:3] == (b"en", b"the", b"big") for b in bounds) > 5
    same(run(frame(spark, rows), range_bytes=2000), brute(rows))


def test_products_pass_64_bits(spark):
    n = 5_000_000_000
    df = spark.createDataFrame([(n, n, n + 1)], "a long, l long, r long")
    x = {c: f"cast({c} as decimal(38,0))" for c in "alr"}
    got = df.selectExpr(f"(cast(1000000 as decimal(38,0)) * {x['a']} * {x['a']}) div ({x['l']} * {x['r']}) AS s").first()[0]
    assert got == 10**6 * n * n // (n * (n + 1)) == 999_999


def test_transducer():
    rng = np.random.default_rng(3)
    for depth, kinds, n in [(1, 5, 9), (3, 4, 200), (4, 30, 5000)]:
        cols, w = P.sorted_sums([rng.integers(0, kinds, n) for _ in range(depth)], rng.integers(1, 3, n))
        symbols = sorted(f"s{i}".encode() for i in range(kinds))
        a = P.Automaton.load(P.Automaton.of(pa.array(symbols), cols, w).dump())
        back, weight = a.paths()
        names = a.symbols.to_pylist()
        rows = list(zip(*[[names[i] for i in c.tolist()] for c in back], weight.tolist(), strict=True))
        assert rows == list(zip(*[[symbols[i] for i in c.tolist()] for c in cols], w.tolist(), strict=True))
        asked = [r[:-1] for r in rows] + [(b"none",) * depth, (*rows[0][:-2], b"none")]
        assert a.weights(asked).tolist() == [r[-1] for r in rows] + [0, 0]
        for first, sym, to in a.levels:  # minimal: no two states with the same arcs
            states = [tuple(zip(sym[x:y].tolist(), to[x:y].tolist(), strict=True)) for x, y in zip(first[:-1], first[1:], strict=True)]
            assert len(states) == len(set(states))
    slow = P.Builder(4)
    slow.SLAB = 3
    x, y = P.Automaton(symbols, slow.build(cols, w)), P.Automaton(symbols, P.Builder(4).build(cols, w))
    assert [len(f) for f, _, _ in x.levels] == [len(f) for f, _, _ in y.levels]  # numbers of states may differ, not how many
    assert all((p == q).all() for p, q in zip((*x.paths()[0], x.paths()[1]), (*y.paths()[0], y.paths()[1]), strict=True))
