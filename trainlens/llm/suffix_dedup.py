"""Suffix-array dedup by two-stage sorting.

Bytes covered by a string of ``width`` bytes that also starts earlier in the
corpus are removed. ``windows`` brings the runs of text that may repeat
together in shards. A shard lays its runs out as one text, each run ended by a
terminator, and orders the suffixes that begin a window:

* suffixes smaller than their successor are sorted directly, by their first
  ``width`` bytes;
* the others are induced: buckets of first bytes are scanned upwards, and each
  suffix met puts the one before it, if that is larger than it, at the next
  free place of its own bucket.

A run's last window start may need successors beyond it to be induced from;
those up to the next directly sorted suffix join the order as helpers. The
common prefixes of neighbours then tell equal windows.

Defined results: a null or empty text has no bytes and no spans; texts under
``width`` bytes are kept whole; overlaps count; strings are judged on the
input; what is left is compared and hashed as bytes (it may cut characters);
repeated rows (same doc_id and text) are judged alike and do not remove each
other; a null doc_id comes before all others; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trainlens.llm import common as C
from trainlens.llm import windows as W

WIDTH, GRAM = 100, 32
BLOCK_BYTES = 2 << 20  # text per suffix array


def _ragged(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo, lo+1, ... (n of them) for every entry, in turn."""
    n = np.maximum(n, 0)
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Text:
    """Runs laid out one after the other, ``width`` zero bytes after each (the
    terminators; they also let any window be read without a bounds test)."""

    def __init__(self, runs: list[bytes], starts: np.ndarray, width: int):
        gap = bytes(width + 8)
        self.width = width
        raw = bytes(8) + gap.join(runs) + gap
        self.bytes = np.frombuffer(raw, np.uint8)
        self.words = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
        size = np.fromiter(map(len, runs), np.int64, len(runs))
        self.head = 8 + np.cumsum(size + len(gap)) - size - len(gap)
        self.end = self.head + size
        self.n = starts

    def word(self, at: np.ndarray, i: int) -> np.ndarray:
        """Bytes 8i.. of the suffixes at ``at`` as numbers that order as the
        bytes do; bytes past ``width`` are left out."""
        w = self.words[at + 8 * i].byteswap()
        over = 8 * (i + 1) - self.width
        return w >> np.uint64(8 * over) if over > 0 else w


def smaller_than_next(t: Text) -> np.ndarray:
    """Per place: is the suffix smaller than its successor. A run's last byte
    is larger than the terminator after it."""
    b = t.bytes
    step = np.zeros(len(b), np.int8)
    step[:-1] = np.sign(b[1:].astype(np.int16) - b[:-1])
    step[t.end - 1] = -1
    at = np.where(step != 0, np.arange(len(b)), len(b) - 1)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    return step[nxt] > 0


def sort_directly(t: Text, at: np.ndarray) -> np.ndarray:
    """``at`` ordered by the first ``width`` bytes, eight at a time; only
    suffixes that still tie are looked at again."""
    key = t.word(at, 0)
    at = at[np.argsort(key, kind="stable")]
    key = np.sort(key)
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    for i in range(1, (t.width + 7) // 8):
        single = new & np.append(new[1:], True)
        tied = np.flatnonzero(~single)
        if not len(tied):
            break
        group = np.cumsum(new[tied])
        key = t.word(at[tied], i)
        o = np.lexsort((key, group))
        at[tied] = at[tied][o]
        key, group = key[o], group[o]
        differs = np.ones(len(tied), bool)
        differs[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[tied] = differs
    return at


def suffix_order(t: Text) -> np.ndarray:
    """The window starts of all runs in the order of their suffixes (exact to
    ``width`` bytes), by two-stage sorting."""
    b, small = t.bytes, smaller_than_next(t)
    need = np.zeros(len(b), bool)
    starts = _ragged(t.head, t.n)
    need[starts] = True
    # helpers: from behind a run's last start to the next small suffix
    last = t.head + t.n - 1
    ends = np.zeros(len(b), bool)
    ends[t.end - 1] = True
    halt = np.flatnonzero(small | ends)
    open_ = (t.n > 0) & ~small[np.maximum(last, 0)]
    lo = last[open_] + 1
    hi = halt[np.minimum(np.searchsorted(halt, last[open_]), len(halt) - 1)]
    helper = _ragged(lo, hi - lo + 1)
    is_start = need.copy()
    need[helper] = True
    direct = sort_directly(t, np.flatnonzero(need & small))
    large = need & ~small
    cut = np.searchsorted(b[direct], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]

    def deal(places: np.ndarray) -> None:
        if not len(places):
            return
        c = b[places]
        o = np.argsort(c, kind="stable")
        c, places = c[o], places[o]
        edge = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        for x, y in zip(edge.tolist(), np.append(edge[1:], len(c)).tolist(), strict=True):
            queue[c[x]].append(places[x:y])

    # the terminators come first: they place the last bytes that are needed
    tail = t.end - 1
    deal(tail[large[tail]])
    out = []
    for c in range(256):
        layers = queue[c]
        now = np.concatenate(layers) if layers else np.zeros(0, np.int64)
        bucket = []
        while len(now):  # runs of one byte: each suffix places the one before it
            bucket.append(now)
            before = now - 1
            now = before[large[before] & (b[before] == c)]
        bucket.append(direct[cut[c]:cut[c + 1]])
        row = np.concatenate(bucket)
        if not len(row):
            continue
        out.append(row)
        before = row - 1
        deal(before[large[before] & (b[before] > c)])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[is_start[order]]


def common_prefixes(t: Text, order: np.ndarray) -> np.ndarray:
    """Bytes each suffix shares with the one before it in the order, up to
    ``width``."""
    lcp = np.zeros(len(order), np.int64)
    open_ = np.arange(1, len(order))
    for i in range((t.width + 7) // 8):
        x = t.word(order[open_], i) ^ t.word(order[open_ - 1], i)
        size = min(8, t.width - 8 * i)
        same = x == 0
        lcp[open_[same]] += size
        rest = x[~same]
        lead = np.zeros(len(rest), np.int64)
        for k in range(1, size):
            lead += rest < (np.uint64(1) << np.uint64(8 * (size - k)))
        lcp[open_[~same]] += lead
        open_ = open_[same]
    return lcp


def find_repeats(width: int):
    def method(texts: list[bytes], key: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        off = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=off[1:])
        late = np.zeros(int(off[-1]), bool)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for a, b in W.blocks_by_key(key, sizes, BLOCK_BYTES):
            t = Text(texts[a:b], n[a:b], width)
            order = suffix_order(t)
            group = np.cumsum(common_prefixes(t, order) < width)
            run = np.searchsorted(t.head, order, side="right") - 1
            rel = order - t.head[run]
            # suffixes alone in their group have nothing earlier
            twin = np.zeros(len(order), bool)
            twin[1:] = group[1:] == group[:-1]
            twin[:-1] |= twin[1:]
            run, rel = run[twin], rel[twin]
            hit = W.earliest(doc[a:b][run], at[a:b][run] + rel, group[twin])
            late[(off[a:b][run] + rel)[hit]] = True
        return late
    return method


def _finish(width: int, with_bytes: bool):
    def finish(t: pa.Table, late: pa.Table) -> pa.Table:
        buf, off = C.buffer_of(t.column("text"))
        rid = t.column("rid").to_numpy()
        late = late.take(pa.array(np.argsort(late.column("rid").to_numpy(), kind="stable")))
        lr = late.column("rid").to_numpy()
        removed, spans, sha, kept = [], [], [], []
        for a, b in C.pieces(off):
            o = off[a:b + 1] - off[a]
            want = np.unique(rid[a:b])
            lo = np.searchsorted(lr, want, side="left")
            pick = _ragged(lo, np.searchsorted(lr, want, side="right") - lo)
            gone = W.covered(np.diff(o), rid[a:b], late.take(pa.array(pick)), width)
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            edges = o[:-1][np.diff(o) > 0]
            begin[edges] = gone[edges]
            count = lambda m: np.diff(np.append(0, np.cumsum(m))[o])
            removed.append(count(gone))
            spans.append(count(begin))
            left = buf[off[a]:off[b]][~gone].tobytes()
            ko = np.append(0, np.cumsum(~gone))[o].tolist()
            for x, y in zip(ko[:-1], ko[1:], strict=True):
                sha.append(hashlib.sha256(left[x:y]).hexdigest())
                if with_bytes:
                    kept.append(left[x:y])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        cols = {"doc_id": t.column("doc_id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(cat(removed), pa.int64()),
                "n_spans": pa.array(cat(spans), pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"kept_bytes": pa.array(kept, pa.binary())} if with_bytes else {}))
    return finish


def dedup(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, crowd: int = 20_000, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_bytes) of
    every row."""
    spark = docs.sparkSession
    C.prepare(spark)
    parts = 4 * C.shuffle_partitions(spark)
    base = W.texts_by_part(docs, parts)
    late = W.later_windows(base, W.Symbols(width, gram, W.byte_pieces), find_repeats(width), shards=parts, crowd=crowd)
    return base.groupBy("part").cogroup(late.groupBy("part")).applyInArrow(
        _finish(width, with_bytes),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_bytes)
