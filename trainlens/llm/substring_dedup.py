"""Substring dedup by repeated-phrase automata.

Words covered by a passage of ``width`` words that also starts earlier in the
corpus are removed. ``windows`` brings together, shard by shard, the runs of
text that may repeat; here a shard confirms which of its passages really recur,
compiles them into Aho-Corasick automata (a word is one letter, so a match is
exact) and streams its runs through them, which locates every occurrence. A
passage's automaton and all text that can hold it share a shard, so each run is
streamed once however large the corpus is. Automata are compiled per block of a
shard, which bounds their memory.

Defined results: a null or empty text has no words, nothing removed and an
empty kept text; texts under ``width`` words are kept whole; overlaps count;
windows are judged on the input; repeated rows (same doc_id and text) are
judged alike and do not remove each other; a null doc_id comes before all
others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trainlens.llm import common as C
from trainlens.llm import windows as W

WIDTH, GRAM = 20, 5
BLOCK_BYTES = 2 << 20  # text per automaton


def _as_text(code: np.ndarray) -> str:
    """Codes as characters (surrogates left out); 0 is the separator."""
    c = code.astype(np.uint32) + 1
    c[c >= 0xD800] += 0x800
    return c.astype("<u4").tobytes().decode("utf-32-le")


def locate(width: int):
    def method(texts: list[bytes], key: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        off = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=off[1:])
        late = np.zeros(int(off[-1]), bool)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in W.blocks_by_key(key, sizes, BLOCK_BYTES):
            late[off[a]:off[b]] = _block(texts[a:b], doc[a:b], at[a:b], n[a:b], width)
        return late
    return method


def _block(texts: list[bytes], doc: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    buf, off = C.buffer_of(pa.array(texts, pa.binary()))
    s, e, wo = C.spans(buf, off)
    code, words = C.codes(buf, s, e)
    # a word met once lies in no recurring passage
    times = np.bincount(code, minlength=len(words))
    new = np.zeros(len(words), np.int64)
    known = times > 1
    new[known] = np.arange(1, int(known.sum()) + 1)
    code = new[code]
    # every text followed by a separator
    line = np.zeros(len(code) + len(texts), np.int64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(wo))
    line[np.arange(len(code)) + text_of] = code
    heads = wo[:-1] + np.arange(len(texts))
    # confirm: windows without a separator whose content is met twice
    zeros = np.zeros(len(line) + 1, np.int64)
    np.cumsum(line == 0, out=zeros[1:])
    late = np.zeros(int(n.sum()), bool)
    if len(line) < width:
        return late
    inner = np.flatnonzero(zeros[width:] == zeros[:-width])
    if not len(inner):
        return late
    g = C.grams(C.mix(line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), width)[inner]
    _, first, count = np.unique(g, return_index=True, return_counts=True)
    phrases = inner[first[count > 1]]
    if not len(phrases):
        return late
    if int(known.sum()) < 1_100_000:
        auto, stream = ahocorasick.Automaton(ahocorasick.STORE_INTS), _as_text(line)
    else:  # more words than characters: letters as numbers
        auto, stream = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), tuple(line.tolist())
    for i, p in enumerate(phrases.tolist()):
        auto.add_word(stream[p:p + width], i)
    auto.make_automaton()
    found = np.array(list(auto.iter(stream)), np.int64).reshape(-1, 2)
    start, phrase = found[:, 0] - width + 1, found[:, 1]
    text = np.searchsorted(heads, start, side="right") - 1
    rel = start - heads[text]
    hit = W.earliest(doc[text], at[text] + rel, phrase)
    first_of = np.cumsum(n) - n
    late[(first_of[text] + rel)[hit]] = True
    return late


def _finish(width: int, with_text: bool, carry: tuple[str, ...]):
    def finish(t: pa.Table, late: pa.Table) -> pa.Table:
        buf, off = C.buffer_of(t.column("text"))
        rid = t.column("rid").to_numpy()
        n_words, n_removed, sha, kept = [], [], [], []
        order = np.argsort(late.column("rid").to_numpy(), kind="stable")
        late = late.take(pa.array(order))
        lr = late.column("rid").to_numpy()
        for a, b in C.pieces(off):
            o = off[a:b + 1] - off[a]
            part = buf[off[a]:off[b]]
            s, e, wo = C.spans(part, o)
            want = np.unique(rid[a:b])
            lo, hi = np.searchsorted(lr, want, side="left"), np.searchsorted(lr, want, side="right")
            times = hi - lo
            pick = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            gone = W.covered(np.diff(wo), rid[a:b], late.take(pa.array(pick)), width)
            stay = np.flatnonzero(~gone)
            # kept words, each followed by a space, then cut per text
            ln = (e - s)[stay]
            start = np.cumsum(ln + 1) - ln - 1
            data = np.full(int(ln.sum()) + len(ln), 0x20, np.uint8)
            inside = np.ones(len(data), bool)
            inside[start + ln] = False
            word_no = np.cumsum(np.isin(np.arange(len(part)), s, assume_unique=True)) - 1 if len(part) else np.zeros(0, np.int64)
            mask = ~C.SPACE[part]
            data[inside] = part[mask][~gone[word_no[mask]]] if len(s) else part[mask]
            raw = data.tobytes()
            ko = np.searchsorted(stay, wo)
            edge = np.append(start, len(raw))[ko]
            n_words.append(np.diff(wo))
            n_removed.append(np.diff(wo) - np.diff(ko))
            for i, (x, y, lost) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), n_removed[-1].tolist(), strict=True)):
                text = raw[x:max(x, y - 1)]
                sha.append(hashlib.sha256(text).hexdigest())
                if with_text:
                    kept.append(text if lost else part[o[i]:o[i + 1]].tobytes())
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        cols = {"doc_id": t.column("doc_id"), "n_words": pa.array(cat(n_words), pa.int64()),
                "n_removed": pa.array(cat(n_removed), pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if with_text:
            cols["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(cols | {c: t.column(c) for c in carry})
    return finish


def dedup(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, crowd: int = 20_000, with_text: bool = True,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; kept_text, which
    is the text itself where nothing is removed; and the columns ``carry``."""
    spark = docs.sparkSession
    C.prepare(spark)
    parts = 4 * C.shuffle_partitions(spark)
    base = W.texts_by_part(docs, parts, carry)
    sym = W.Symbols(width, gram, W.word_pieces)
    late = W.later_windows(base, sym, locate(width), shards=parts, crowd=crowd)
    return base.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(
        _finish(width, with_text, carry),
        "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry))
