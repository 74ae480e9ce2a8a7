"""Finding windows of symbols that recur anywhere in a corpus, without sending
every window through a shuffle.

A window of ``width`` symbols is keyed by the least hash among the grams (runs
of ``gram`` symbols) inside it. Equal windows have equal keys, and neighbouring
windows mostly share one, so a text is a short list of runs of windows with
one key each. The steps, each a keyed shuffle:

1. every block of texts reports each of its keys once;
2. keys seen twice or more go back to the blocks that have them;
3. those blocks send, per run under such a key, the run's text to the key's
   shard. A block sends equal runs once (the first by document and place) and
   marks the later ones itself, so a key never gets more than one copy of a
   run from a block, however many copies the corpus holds. A key shared by
   very many different runs (a common short line) is split: its windows are
   sent one by one under a hash of the whole window;
4. the shard (its method is the caller's) says which window starts have an
   earlier equal window; the answers go back to the blocks.

Documents are compared as (doc_id, start), nulls first; only a strictly smaller
pair is earlier, so repeated rows are judged alike and none removes the other.
Hashes only route; equality is decided on the text itself in the shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlens.llm import common as C

NO_ID = -(1 << 63)  # the place of a null doc_id: before all others
SEND = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("text", pa.binary()), ("part", pa.int32()),
                  ("rid", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])
LATE = pa.schema([("part", pa.int32()), ("rid", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])


@dataclass
class Piece:
    """Some texts as symbols. ``data`` holds their canonical bytes, ``start``
    and ``end`` each symbol's place there, ``off`` each text's first symbol,
    ``row`` each text's row, ``base`` the number of its first symbol within
    the document (long documents come in overlapping pieces), ``gram`` a hash
    per run of symbols."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray
    row: np.ndarray
    base: np.ndarray
    gram: np.ndarray


@dataclass(frozen=True)
class Symbols:
    width: int
    gram: int
    pieces: Callable[[np.ndarray, np.ndarray, int, int], Iterator[Piece]]


def byte_pieces(buf: np.ndarray, off: np.ndarray, width: int, gram: int) -> Iterator[Piece]:
    """Every byte a symbol; ``gram`` is a multiple of 8."""
    step = C.PIECE_BYTES

    def one(b: np.ndarray, o: np.ndarray, row: np.ndarray, base: np.ndarray) -> Piece:
        data = b.tobytes()
        n = len(b)
        x = np.ndarray((max(0, n - 7),), "<u8", data, 0, (1,)) if n >= 8 else np.zeros(0, np.uint64)
        m = max(0, n - gram + 1)
        h = np.zeros(m, np.uint64)
        for j in range(0, gram, 8):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[j:j + m]
            h ^= h >> np.uint64(29)
        at = np.arange(n)
        return Piece(data, at, at + 1, o, row, base, C.mix(h))

    for a, b in C.pieces(off, step):
        o = off[a:b + 1]
        if o[-1] - o[0] <= 2 * step or b - a > 1:
            yield one(buf[o[0]:o[-1]], o - o[0], np.arange(a, b), np.zeros(b - a, np.int64))
        else:
            for at in range(int(o[0]), int(o[-1]) - width + 1, step):
                end = min(int(o[-1]), at + step + width - 1)
                yield one(buf[at:end], np.array([0, end - at]), np.array([a]), np.array([at - o[0]]))


def word_pieces(buf: np.ndarray, off: np.ndarray, width: int, gram: int) -> Iterator[Piece]:
    """Words as symbols; canonical bytes join a text's words by one space."""
    step = C.PIECE_BYTES

    def one(b: np.ndarray, o: np.ndarray, row: np.ndarray, base: np.ndarray) -> tuple[Piece, np.ndarray]:
        s, e, wo = C.spans(b, o)
        code, words = C.codes(b, s, e)
        ln = e - s
        start = np.zeros(len(s), np.int64)
        if len(s):
            np.cumsum(ln[:-1] + 1, out=start[1:])
        # the bytes of every word followed by one space
        total = int(ln.sum()) + len(s)
        data = np.full(total, 0x20, np.uint8)
        inside = np.ones(total, bool)
        inside[start + ln] = False
        data[inside] = b[~C.SPACE[b]]
        return Piece(data.tobytes(), start, start + ln, wo, row, base, C.grams(C.hashes(words)[code], gram)), s

    for a, b in C.pieces(off, step):
        o = off[a:b + 1]
        if o[-1] - o[0] <= 2 * step or b - a > 1:
            yield one(buf[o[0]:o[-1]], o - o[0], np.arange(a, b), np.zeros(b - a, np.int64))[0]
            continue
        at, end, base, size = int(o[0]), int(o[-1]), 0, step
        while at < end:
            cut = min(end, at + size)
            while cut < end and not C.SPACE[buf[cut]]:
                cut += 1
            p, s = one(buf[at:cut], np.array([0, cut - at]), np.array([a]), np.array([base]))
            if cut < end and len(s) < 2 * width:
                size *= 2  # words too long for this step
                continue
            yield p
            if cut >= end:
                break
            back = len(s) - (width - 1)  # the next piece begins with this piece's last words
            base, at, size = base + back, at + int(s[back]), step


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    m, s = h, 1
    while 2 * s <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[:len(m) - (w - s)], m[w - s:]) if s < w else m


def runs(p: Piece, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key: first window, count, key, and whether two
    of the run's own windows may be equal."""
    n = int(p.off[-1])
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, none.view(np.uint64), none.astype(bool)
    m = sliding_min(p.gram, width - gram + 1)
    L = len(m)
    edge = np.zeros(n + 1, np.int32)
    lo = np.maximum(p.off[:-1], p.off[1:] - width + 1)
    np.add.at(edge, lo, 1)
    np.add.at(edge, p.off[1:], -1)
    fits = np.cumsum(edge)[:L] == 0
    new = np.ones(L, bool)
    new[1:] = (m[1:] != m[:-1]) | ~fits[:-1]
    stop = np.append(np.flatnonzero(new | ~fits), L)
    st = np.flatnonzero(new & fits)
    en = stop[np.searchsorted(stop, st, side="right")]
    twin = np.zeros(L + 1, np.int64)
    twin[1:L] = np.cumsum((p.gram[:L - 1] == m[:-1]) & ~new[1:])
    twin[L] = twin[L - 1]
    # places i in the run whose gram is the key and whose next window has it too
    return st, en - st, m[st], twin[en - 1] > twin[st]


def _ids(table: pa.Table, name: str) -> np.ndarray:
    c = table.column(name)
    return pc.fill_null(c.cast(pa.int64()), NO_ID).to_numpy() if len(c) else np.zeros(0, np.int64)


def key_reporter(sym: Symbols) -> Callable[[pa.Table], pa.Table]:
    """Step 1: the keys of a block, each once, with how many different runs
    it has here (2 at least where it occurs more than once)."""
    def report(t: pa.Table) -> pa.Table:
        buf, off = C.buffer_of(t.column("text"))
        keys, ctx, twins = [], [], []
        for p in sym.pieces(buf, off, sym.width, sym.gram):
            st, n, key, twin = runs(p, sym.width, sym.gram)
            if len(st):
                last = st + n - 1 + sym.width - sym.gram
                keys.append(key)
                ctx.append(C.mix(p.gram[st] * np.uint64(31) + p.gram[last]) + n.astype(np.uint64))
                twins.append(twin)
        if not keys:
            return pa.table({"key": pa.array([], pa.int64()), "part": pa.array([], pa.int32()), "runs": pa.array([], pa.int32())})
        k, c, w = np.concatenate(keys), np.concatenate(ctx), np.concatenate(twins)
        o = np.lexsort((c, k))
        k, c, w = k[o], c[o], w[o]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        differs = first.copy()
        differs[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(first)
        count = np.diff(np.append(at, len(k)))
        kinds = np.add.reduceat(differs.astype(np.int32), at)
        twice = np.logical_or.reduceat(w, at) | (count > 1)
        part = t.column("part")[0].as_py()
        return pa.table({"key": pa.array(C.signed(k[at])), "part": pa.array(np.full(len(at), part, np.int32)),
                         "runs": pa.array(np.maximum(kinds, 1 + twice).astype(np.int32))})
    return report


def run_sender(sym: Symbols, shards: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Step 3: the runs of a block that lie under recurring keys."""
    W = sym.width

    def send(t: pa.Table, rec: pa.Table) -> pa.Table:
        if not len(t) or not len(rec):
            return SEND.empty_table()
        part = t.column("part")[0].as_py()
        known = rec.column("key").to_numpy().view(np.uint64)
        crowded = rec.column("crowded").to_numpy(zero_copy_only=False)
        o = np.argsort(known)
        known, crowded = known[o], crowded[o]
        rid, doc = t.column("rid").to_numpy(), _ids(t, "doc_id")
        buf, off = C.buffer_of(t.column("text"))
        texts: list[bytes] = []
        cols: list[tuple[np.ndarray, ...]] = []
        for p in sym.pieces(buf, off, W, sym.gram):
            st, n, key, _ = runs(p, W, sym.gram)
            if not len(st):
                continue
            i = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[i] == key
            st, n, key, i = st[hit], n[hit], key[hit], i[hit]
            split = crowded[i]
            if split.any():  # one row per window, keyed by the whole window
                k = int(n[split].sum())
                each = np.repeat(st[split], n[split]) + np.arange(k) - np.repeat(np.cumsum(n[split]) - n[split], n[split])
                full = np.zeros(k, np.uint64)
                for j in range(0, W - sym.gram + 1):
                    full = C.mix(full * np.uint64(0x9E3779B97F4A7C15) + p.gram[each + j])
                st, n, key = np.concatenate([st[~split], each]), np.concatenate([n[~split], np.ones(k, np.int64)]), np.concatenate([key[~split], full])
            a, b = p.start[st], p.end[st + n + W - 2]
            data = p.data
            texts += [data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            of = np.searchsorted(p.off, st, side="right") - 1
            cols.append((key, p.row[of], st - p.off[of] + p.base[of], n))
        if not texts:
            return SEND.empty_table()
        key, row, at, n = (np.concatenate(x) for x in zip(*cols, strict=True))
        arr = pa.array(texts, pa.binary())
        d = doc[row]
        ship, late = first_of_equal(arr, d, at)
        keep = np.concatenate([np.flatnonzero(ship), np.flatnonzero(late)])
        gone = np.zeros(len(keep), bool)
        gone[int(ship.sum()):] = True
        shard = np.where(gone, rid[row[keep]].view(np.uint64), C.mix(key[keep])) % np.uint64(shards)
        txt = arr.take(pa.array(keep))
        txt = pc.if_else(pa.array(gone), pa.scalar(None, pa.binary()), txt)
        return pa.Table.from_arrays(
            [pa.array(shard.astype(np.int32)), pa.array(C.signed(key[keep])), txt, pa.array(np.full(len(keep), part, np.int32)),
             pa.array(rid[row[keep]]), pa.array(d[keep]), pa.array(at[keep]), pa.array(n[keep].astype(np.int32))], schema=SEND)
    return send


def first_of_equal(texts: pa.Array, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with equal texts: those at the least (doc, at), and the rest."""
    code = texts.dictionary_encode()
    code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
    o = np.lexsort((at, doc, code))
    c, d, a = code[o], doc[o], at[o]
    new = np.ones(len(o), bool)
    new[1:] = c[1:] != c[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    is_first = (d == d[head]) & (a == a[head])
    first = np.empty(len(o), bool)
    first[o] = is_first
    return first, ~first


def judge_shard(method: Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray],
                width: int) -> Callable[[pa.Table], pa.Table]:
    """Step 4 around a method. The method gets different texts with key, doc,
    at and number of windows, and returns one boolean per window (texts in
    turn): whether an equal window starts earlier."""
    def judge(t: pa.Table) -> pa.Table:
        has = pc.is_valid(t.column("text")).to_numpy()
        done = t.filter(pa.array(~has)).select(LATE.names)
        t = t.filter(pa.array(has))
        if not len(t):
            return done.cast(LATE)
        arr = t.column("text").combine_chunks()
        arr = arr if isinstance(arr, pa.Array) else pa.concat_arrays(arr.chunks)
        key, doc, at, n = (t.column(c).to_numpy() for c in ("key", "doc", "at", "n"))
        part, rid = t.column("part").to_numpy(), t.column("rid").to_numpy()
        first, rest = first_of_equal(arr, doc, at)
        # equal rows at the same place: the method sees one of them
        idx = np.flatnonzero(first)
        uniq = arr.take(pa.array(idx)).dictionary_encode()
        code = uniq.indices.to_numpy(zero_copy_only=False)
        _, rep = np.unique(code, return_index=True)
        rep_rows = idx[rep]
        order = np.argsort(key[rep_rows], kind="stable")
        rep_rows = rep_rows[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        late = method([arr[int(i)].as_py() for i in rep_rows], key[rep_rows], doc[rep_rows], at[rep_rows], n[rep_rows].astype(np.int64))
        off = np.zeros(len(rep_rows) + 1, np.int64)
        np.cumsum(n[rep_rows], out=off[1:])
        # maximal ranges of late windows inside each text
        flag = np.zeros(len(late) + 1, bool)
        flag[:-1] = late
        begin = flag[:-1].copy()
        begin[1:] &= ~flag[:-2]
        heads = off[:-1]
        begin[heads] = flag[heads]
        b = np.flatnonzero(begin)
        stops = np.unique(np.concatenate([np.flatnonzero(~flag), off]))
        e = stops[np.searchsorted(stops, b, side="right")]
        text_of = np.searchsorted(off, b, side="right") - 1
        # every first row takes its representative's ranges
        mine = place[code]
        by = np.argsort(mine, kind="stable")
        lo = np.searchsorted(mine[by], text_of, side="left")
        hi = np.searchsorted(mine[by], text_of, side="right")
        times = hi - lo
        pick = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        src = idx[by[pick]]
        rel = np.repeat(b - off[text_of], times)
        size = np.repeat(e - b, times)
        all_late = np.flatnonzero(rest)
        return pa.concat_tables([done.cast(LATE), pa.Table.from_arrays(
            [pa.array(np.concatenate([part[src], part[all_late]]).astype(np.int32)), pa.array(np.concatenate([rid[src], rid[all_late]])),
             pa.array(np.concatenate([at[src] + rel, at[all_late]])),
             pa.array(np.concatenate([size, n[all_late]]).astype(np.int32))], schema=LATE)])
    return judge


def earliest(order_doc: np.ndarray, order_at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether an item is strictly after the least (doc, at) of its group."""
    o = np.lexsort((order_at, order_doc, group))
    g = group[o]
    new = np.ones(len(o), bool)
    new[1:] = g[1:] != g[:-1]
    head = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
    late = np.empty(len(o), bool)
    late[o] = (order_doc[o] != order_doc[head]) | (order_at[o] != order_at[head])
    return late


def blocks_by_key(key: np.ndarray, size: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts (sorted by key) cut between keys, about ``limit`` each."""
    if not len(key):
        return
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    total = np.cumsum(size)
    a, done = 0, 0
    for e in ends.tolist():
        if total[e - 1] - done >= limit:
            yield a, e
            a, done = e, int(total[e - 1])
    if a < len(key):
        yield a, len(key)


def texts_by_part(docs: DataFrame, parts: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """part, rid, doc_id and text of every row, and the columns to carry."""
    rid = C.row_key(F.col("doc_id").cast("long"), F.col("text"))
    return docs.select(F.pmod(rid, F.lit(parts)).cast("int").alias("part"), rid.alias("rid"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)


def later_windows(base: DataFrame, sym: Symbols, method, *, shards: int, crowd: int = 20_000) -> DataFrame:
    """(part, rid, at, n): ranges of window starts of a text that have an equal
    window earlier. ``base`` comes from ``texts_by_part``; ``crowd`` is the
    number of different runs under one key from which the key is split."""
    keys = base.groupBy("part").applyInArrow(key_reporter(sym), "key long, part int, runs int")
    w = Window.partitionBy("key")
    rec = (keys.withColumn("total", F.sum("runs").over(w)).where("total > 1")
           .select("part", "key", (F.col("total") > crowd).alias("crowded")))
    sent = (base.groupBy("part").cogroup(rec.groupBy("part"))
            .applyInArrow(run_sender(sym, shards), "shard int, key long, text binary, part int, rid long, doc long, at long, n int"))
    return sent.groupBy("shard").applyInArrow(judge_shard(method, sym.width), "part int, rid long, at long, n int")


def covered(n_symbols: np.ndarray, rid: np.ndarray, late: pa.Table, width: int) -> np.ndarray:
    """Mask over all symbols of some texts (in turn): inside a late window."""
    off = np.zeros(len(n_symbols) + 1, np.int64)
    np.cumsum(n_symbols, out=off[1:])
    cover = np.zeros(int(off[-1]) + 1, np.int32)
    if len(late) and len(rid):
        lr, at, n = (late.column(c).to_numpy() for c in ("rid", "at", "n"))
        o = np.argsort(lr, kind="stable")
        lr, at, n = lr[o], at[o], n[o]
        lo, hi = np.searchsorted(lr, rid, side="left"), np.searchsorted(lr, rid, side="right")
        times = hi - lo
        pick = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        a = np.repeat(off[:-1], times) + at[pick]
        np.add.at(cover, a, 1)
        np.add.at(cover, a + n[pick] + width - 1, -1)
    return np.cumsum(cover)[:-1] > 0
