"""Phrase collocations by weighted acyclic automata.

Every word occurrence gives one path: its language, itself and the words behind
it in its piece, up to ``max_words``, filled up with the empty symbol where the
piece ends. How often a phrase occurs is then the weight of a prefix, and all
paths with a prefix lie in one range of the sorted paths.

* Shards. A task sorts the paths of some million words, sums equal ones and
  builds a minimal acyclic transducer from them: states are closed and looked
  up in a register as soon as the sorted input has left them, and a state with
  the same arcs and weights as an earlier one is that one.
* Union. Paths are dealt by prefix ranges of about ``range_bytes`` of text,
  with bounds taken from an even sample of text windows (bounds decide balance
  only, never results). A range's transducers are united, weights summed, and
  the weights of all prefixes are range sums. Those of ``min_count`` and more
  are kept as a transducer; so are, whatever their weight, the prefixes of a
  range's first and last path, as only these can continue in another range.
* Composition. The parts of every candidate are looked up as paths of the
  transducers of the ranges that hold them, and the partial weights are added.

A frequent word or phrase is no task's burden: its paths are spread over as
many ranges as they need and every shard sends a path once. Up to
``MAX_RANGES`` bounds pass through the driver; beyond them ranges grow.

Defined results: a null text is empty; a null language is ``und``; repeated
rows count each; a null doc_id is an ordinary value; other columns are ignored;
an empty table gives an empty result. Ties are ordered by count, then phrase in
UTF-8 byte order. Arithmetic is exact in 38 decimal digits.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainlens.llm import common as C

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
SHARD_WORDS = 2_000_000
RANGE_BYTES, MAX_RANGES = 10 << 20, 50_000
SAMPLE_CHARS, PER_RANGE = 4096, 60
BOUND_BYTES = 64  # of a symbol in a bound
SALTS = 64

# white space inside a piece 1, ends of pieces 2, words 0
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
END, TOTAL = b"", b"\n"  # neither is a word

Path = tuple[bytes, ...]


def sorted_sums(cols: list[np.ndarray], weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of the code columns in order, and their summed weights."""
    if not len(weight):
        return cols, weight
    key, span = cols[0].astype(np.int64), int(cols[0].max()) + 1
    for c in cols[1:]:
        width = int(c.max()) + 1
        if span * width >= 1 << 62:
            u, key = np.unique(key, return_inverse=True)
            span = len(u)
        key, span = key * width + c, span * width
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return [c[order[first]] for c in cols], np.add.reduceat(weight[order], first)


def _groups(cols: list[np.ndarray], n: int) -> np.ndarray:
    """Starts of the runs of equal rows among ``n`` sorted ones."""
    new = np.zeros(n, bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Builder:
    """A minimal acyclic transducer from sorted paths, slab by slab. A slab ends
    where a new state of the last level begins, so all its states are closed."""

    SLAB = 1 << 16

    def __init__(self, depth: int):
        self.depth = depth
        self.register: list[dict[bytes, int]] = [{} for _ in range(depth)]
        self.arcs: list[list[np.ndarray]] = [[] for _ in range(depth)]
        self.sizes: list[list[np.ndarray]] = [[] for _ in range(depth)]

    def _close(self, level: int, sym: np.ndarray, to: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of the states whose arcs begin at ``starts``."""
        known, width = self.register[level], 16
        arcs = np.stack([sym.astype(np.int64), to.astype(np.int64)], 1)
        size = np.diff(np.append(starts, len(sym)))
        ids = np.empty(len(starts), np.int64)

        def enter(rows: np.ndarray, at: list[int], n: list[int]) -> list[int]:
            raw = rows.tobytes()
            return [known.setdefault(raw[width * i:width * (i + k)], len(known)) for i, k in zip(at, n, strict=True)]

        # states of one arc, most of all, meet as numbers before the register
        single = np.flatnonzero(size == 1)
        if len(single):
            base = int(to.max()) + 1
            key, code = np.unique(arcs[starts[single], 0] * base + arcs[starts[single], 1], return_inverse=True)
            ids[single] = np.array(enter(np.stack([key // base, key % base], 1), list(range(len(key))), [1] * len(key)), np.int64)[code]
        more = np.flatnonzero(size > 1)
        ids[more] = enter(arcs, starts[more].tolist(), size[more].tolist())
        return ids

    def build(self, cols: list[np.ndarray], weight: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first arc of every state, symbols, targets) per level; the targets of
        the last level are weights."""
        n, last = len(weight), self.depth - 1
        to = weight.astype(np.int64)
        for level in range(last, -1, -1):
            starts = _groups(cols[:level], n)
            ids = np.empty(len(starts), np.int64)
            k = 0
            while k < len(starts):  # slabs of closed states
                m = max(k + 1, int(np.searchsorted(starts, starts[k] + self.SLAB)))
                a, b = int(starts[k]), int(starts[m]) if m < len(starts) else n
                ids[k:m] = self._close(level, cols[level][a:b], to[a:b], starts[k:m] - a)
                k = m
            cols, to, n = [c[starts] for c in cols[:level]], ids, len(starts)
        out = []
        for known in self.register:  # a register lists its states in their order
            arcs = np.frombuffer(b"".join(known), np.int64).reshape(-1, 2)
            size = np.fromiter(map(len, known), np.int64, len(known)) // 16
            out.append((np.append(0, np.cumsum(size)), arcs[:, 0], arcs[:, 1]))
        return out


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if top <= np.iinfo(t).max))


@dataclass
class Automaton:
    """Symbols in byte order and, per level, first arcs, symbols and targets."""

    symbols: pa.Array
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, symbols: pa.Array, cols: list[np.ndarray], weight: np.ndarray) -> Automaton:
        """From sorted different paths in codes of ``symbols`` (sorted); symbols
        that no path has are left out."""
        used = np.zeros(len(symbols), bool)
        for c in cols:
            used[c] = True
        code = np.cumsum(used) - 1
        return cls(symbols.take(pa.array(np.flatnonzero(used))), Builder(len(cols)).build([code[c] for c in cols], weight))

    def paths(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All paths, sorted, as code columns, and their weights."""
        state, cols = np.zeros(1, np.int64), []
        for first, sym, to in self.levels:
            size = first[state + 1] - first[state]
            ends = np.cumsum(size)
            at = np.repeat(first[state] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
            cols = [np.repeat(c, size) for c in cols] + [sym[at]]
            state = to[at]
        return cols, state

    def weights(self, paths: list[Path]) -> np.ndarray:
        """Weights of whole paths, 0 where there is none."""
        code = {s: i for i, s in enumerate(self.symbols.to_pylist())}
        v = len(self.symbols)
        state, alive = np.zeros(len(paths), np.int64), np.ones(len(paths), bool)
        for level, (first, sym, to) in enumerate(self.levels):
            goal = np.fromiter((code.get(p[level], -1) for p in paths), np.int64, len(paths))
            arc = np.repeat(np.arange(len(first) - 1), np.diff(first)) * v + sym  # ascending
            key = state * v + goal
            at = np.minimum(np.searchsorted(arc, key), len(arc) - 1)
            alive &= (goal >= 0) & (arc[at] == key)
            state = np.where(alive, to[at], 0)
        return np.where(alive, state, 0)

    def dump(self) -> bytes:
        words, ends = C.buffer_of(self.symbols)
        arrays = [_narrow(x) for x in (np.diff(ends), *[x for first, sym, to in self.levels for x in (np.diff(first), sym, to)])]
        head = json.dumps([len(words), [[str(a.dtype), len(a)] for a in arrays]]).encode()
        body = len(head).to_bytes(4, "little") + head + words.tobytes() + b"".join(a.tobytes() for a in arrays)
        return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)

    @classmethod
    def load(cls, raw: bytes) -> Automaton:
        body = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
        at = 4 + int.from_bytes(body[:4], "little")
        n_words, shapes = json.loads(body[4:at])
        words = body[at:at + n_words]
        at += n_words
        arrays = []
        for kind, n in shapes:
            x = np.frombuffer(body, kind, n, at)
            arrays.append(x.astype(np.int64))
            at += x.nbytes
        ends = np.append(0, np.cumsum(arrays[0])).astype(np.int32)
        return cls(pa.Array.from_buffers(pa.binary(), len(arrays[0]), [None, pa.py_buffer(ends), pa.py_buffer(words)]),
                   [(np.append(0, np.cumsum(arrays[i])), arrays[i + 1], arrays[i + 2]) for i in range(1, len(arrays), 3)])


def sorted_symbols(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words in byte order, and every word's place among them."""
    d = words.dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy().astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return d.dictionary.take(pa.array(order)), rank[d.indices.to_numpy(zero_copy_only=False)]


def union(automata: Iterator[Automaton]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    """Symbols, sorted paths and summed weights of all."""
    parts = [(a.symbols, *a.paths()) for a in automata]
    symbols, place = sorted_symbols(pa.concat_arrays([s for s, _, _ in parts]))
    cols: list[list[np.ndarray]] = []
    at = 0
    for own, c, _ in parts:
        to = place[at:at + len(own)]
        at += len(own)
        cols.append([to[x] for x in c])
    merged = [np.concatenate(x) for x in zip(*cols, strict=True)]
    return symbols, *sorted_sums(merged, np.concatenate([w for _, _, w in parts]))


def prefix_totals(cols: list[np.ndarray], weight: np.ndarray, symbols: pa.Array, min_count: int) -> Automaton:
    """Weights of all prefixes that reach ``min_count`` or may go on in another
    range, as paths filled up with ``TOTAL``."""
    depth, out, sums = len(cols), [], []
    end = pc.index(symbols, END).as_py()
    symbols, place = sorted_symbols(pa.concat_arrays([symbols, pa.array([TOTAL], pa.binary())]))
    cols, at = [place[c] for c in cols], int(place[-1])
    end = int(place[end]) if end >= 0 else -1
    for k in range(1, depth + 1):
        starts = _groups(cols[:k], len(weight))
        f = np.add.reduceat(weight, starts)
        edge = np.zeros(len(starts), bool)
        if k < depth:
            edge[[0, -1]] = True
        real = np.ones(len(starts), bool) if k == 1 else cols[k - 1][starts] != end
        keep = np.flatnonzero(real & ((f >= min_count) | edge | (k == 1)))
        out.append([c[starts[keep]] for c in cols[:k]] + [np.full(len(keep), at)] * (depth - k))
        sums.append(f[keep])
    return Automaton.of(symbols, *sorted_sums([np.concatenate(x) for x in zip(*out, strict=True)], np.concatenate(sums)))


def words_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased buffer, word starts and ends, each word's text, and whether a
    piece ends behind it."""
    low = LOWER[buf]
    kind = KIND[low]
    word = kind == 0
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | edge[1:-1]
    end[:-1] &= ~word[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    text = np.searchsorted(off, s, side="right") - 1
    stops = np.flatnonzero(kind == 2)
    seen = np.searchsorted(stops, s)
    last = np.ones(len(s), bool)
    last[:-1] = (seen[1:] != seen[:-1]) | (text[1:] != text[:-1])
    return low, s, e, text, last


def _blocks(buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Buffers of a few megabytes with their offsets and first text; a longer
    text is cut where its pieces end."""
    for lo, hi in C.pieces(off):
        part, o = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        if len(part) <= 2 * C.PIECE_BYTES or hi - lo > 1:
            yield part, o, lo
            continue
        stops, a = np.flatnonzero(KIND[part] == 2) + 1, 0
        while a < len(part):
            k = int(np.searchsorted(stops, a + C.PIECE_BYTES))
            b = int(stops[k]) if k < len(stops) else len(part)
            yield part[a:b], np.array([0, b - a]), lo
            a = b


def _lang(x: str | None) -> bytes:
    return b"und" if x is None else x.encode()


class _Shard:
    """Word codes of a task's texts until there are enough for a transducer."""

    def __init__(self, max_words: int, bounds: list[Path]):
        self.max_words, self.bounds = max_words, bounds
        self.clear()

    def clear(self) -> None:
        # every buffer's own words follow the empty symbol; they meet in rows()
        self.words: list[pa.Array] = [pa.array([END], pa.binary())]
        self.n_words = 1
        self.code: list[np.ndarray] = []
        self.last: list[np.ndarray] = []
        self.lang: list[np.ndarray] = []
        self.n = 0

    def add(self, buf: np.ndarray, off: np.ndarray, langs: list[str | None]) -> None:
        low, s, e, text, last = words_of(buf, off)
        if not len(s):
            return
        code, words = C.codes(low, s, e)
        used = np.zeros(len(words), bool)
        used[code] = True
        self.code.append((np.cumsum(used) - 1 + self.n_words)[code])
        self._enter(words.take(pa.array(np.flatnonzero(used))))
        self.last.append(last)
        names = pa.array([_lang(x) for x in langs], pa.binary()).dictionary_encode()
        self.lang.append((names.indices.to_numpy(zero_copy_only=False) + self.n_words)[text])
        self._enter(names.dictionary)
        self.n += len(s)

    def _enter(self, words: pa.Array) -> None:
        self.words.append(words)
        self.n_words += len(words)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        """(range, transducer) of everything added."""
        if not self.n:
            return
        symbols, place = sorted_symbols(pa.concat_arrays(self.words))
        end, word, lang = place[0], place[np.concatenate(self.code)], place[np.concatenate(self.lang)]
        last = np.concatenate(self.last)
        self.clear()
        cols, inside = [lang, word], ~last
        for k in range(1, self.max_words):
            nxt = np.full(len(word), end)
            nxt[:-k] = np.where(inside[:-k], word[k:], end)
            cols.append(nxt)
            inside[:-k] &= ~last[k:]
            inside[-k:] = False
        cols, weight = sorted_sums(cols, np.ones(len(word), np.int64))
        names = symbols.to_pylist()
        cuts = [0, *[_place(names, cols, b) for b in self.bounds], len(weight)]
        for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                yield r, Automaton.of(symbols, [c[a:b] for c in cols], weight[a:b]).dump()


def _place(symbols: list[bytes], cols: list[np.ndarray], bound: Path) -> int:
    """How many sorted paths lie before ``bound``."""
    a, b = 0, len(cols[0])
    for c, s in zip(cols, bound, strict=True):
        i = bisect.bisect_left(symbols, s)
        lo = a + int(np.searchsorted(c[a:b], i))
        if i == len(symbols) or symbols[i] != s:
            return lo
        a, b = lo, a + int(np.searchsorted(c[a:b], i, side="right"))
    return a


def _shards(max_words: int, bounds: list[Path], shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(max_words, bounds)

        def out() -> Iterator[pa.RecordBatch]:
            for r, raw in shard.rows():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([raw], pa.binary())], ["range", "block"])
        for b in batches:
            buf, off = C.buffer_of(b.column(b.schema.get_field_index("text")))
            langs = b.column(b.schema.get_field_index("lang")).to_pylist()
            for part, o, lo in _blocks(buf, off):
                shard.add(part, o, langs[lo:lo + len(o) - 1])
                if shard.n >= shard_words:
                    yield from out()
        yield from out()
    return run


def _sample_paths(max_words: int):
    """One path of every text window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = C.buffer_of(b.column(b.schema.get_field_index("text")))
            langs = b.column(b.schema.get_field_index("lang")).to_pylist()
            low, s, e, text, last = words_of(buf, off)
            out = []
            edge = np.searchsorted(text, np.arange(len(off)))
            for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if y - x < 2:
                    continue
                # any word but the first, in whose middle a window may begin
                i = x + 1 + zlib.crc32(low[s[x]:e[y - 1]]) % (y - x - 1)
                path, j = [_lang(langs[text[i]])], i
                while len(path) <= max_words:
                    path.append(low[s[j]:e[j]].tobytes())
                    if last[j]:
                        break
                    j += 1
                path += [END] * (max_words + 1 - len(path))
                out.append([p[:BOUND_BYTES] for p in path])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.binary()))], ["path"])
    return run


def range_bounds(docs: DataFrame, max_words: int, range_bytes: int) -> list[Path]:
    """Paths that cut the corpus into ranges of about ``range_bytes`` of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MAX_RANGES, -(-total // range_bytes))
    if ranges <= 1:
        return []
    windows = f"sequence(0, cast(length(text) div {SAMPLE_CHARS} as int))"
    every = max(1, total // (SAMPLE_CHARS * PER_RANGE * ranges))
    picked = F.expr(f"transform(filter({windows}, w -> pmod(xxhash64(11, doc_id, octet_length(text), w), {every}L) = 0), "
                    f"w -> substring(text, w * {SAMPLE_CHARS} + 1, {SAMPLE_CHARS // 8}))")
    sample = docs.where("text IS NOT NULL").select("lang", F.explode(picked).alias("text"))
    # about PER_RANGE short paths a range
    paths = sorted(tuple(bytes(x) for x in r["path"]) for r in sample.mapInArrow(_sample_paths(max_words), "path array<binary>").toLocalIterator())
    return sorted({paths[len(paths) * i // ranges] for i in range(1, ranges)}) if paths else []


def _unite(min_count: int):
    def run(t: pa.Table) -> pa.Table:
        symbols, cols, weight = union(Automaton.load(x) for x in t.column("block").to_pylist())
        block = prefix_totals(cols, weight, symbols, min_count).dump()
        return pa.table({"range": t.column("range")[:1], "block": pa.array([block], pa.binary())})
    return run


def count_blocks(docs: DataFrame, bounds: list[Path], *, max_words: int, min_count: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(range, block): a transducer of prefix weights per range."""
    shards = docs.select("lang", "text").mapInArrow(_shards(max_words, bounds, shard_words), "range int, block binary")
    return shards.groupBy("range").applyInArrow(_unite(min_count), "range int, block binary")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(b.schema.get_field_index("block")).to_pylist():
            a = Automaton.load(raw)
            cols, f = a.paths()
            name = np.array(a.symbols.to_pylist(), object)
            size = (np.stack(cols[1:]) != pc.index(a.symbols, TOTAL).as_py()).sum(0)
            lang = [x.decode() for x in name[cols[0]]]
            words = [b" ".join(p[:n]).decode() for p, n in zip(zip(*[name[c] for c in cols[1:]], strict=True), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(words, pa.string()), pa.array(size.astype(np.int32)), pa.array(f)],
                                             ["lang", "phrase", "size", "f"])


def totals(blocks: DataFrame) -> DataFrame:
    """(lang, phrase, size, f) of every counted phrase; size 0 has all words.
    Phrases at the ends of ranges may have less than the least count."""
    rows = blocks.mapInArrow(_totals, "lang string, phrase string, size int, f long")
    return rows.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def _deal(bounds: list[Path]):
    """Every part goes to all ranges that its paths may lie in."""
    heads = [[b[:k] for b in bounds] for k in range(len(bounds[0]) + 1)] if bounds else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, part = (b.column(b.schema.get_field_index(c)) for c in ("lang", "part"))
            row, ranges = [], []
            for i, (x, p) in enumerate(zip(lang.to_pylist(), part.to_pylist(), strict=True)):
                path = (x.encode(), *p.encode().split(b" "))
                lo = hi = 0
                if bounds:
                    lo = bisect.bisect_right(bounds, path + (END,) * (len(bounds[0]) - len(path)))
                    hi = bisect.bisect_right(heads[len(path)], path)
                row += [i] * (hi - lo + 1)
                ranges += range(lo, hi + 1)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), lang.take(take), part.take(take)], ["range", "lang", "part"])
    return run


def _compose(depth: int):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        f = np.zeros(len(asked), np.int64)
        paths = [(x.encode(), *(w := p.encode().split(b" ")), *[TOTAL] * (depth - 1 - len(w)))
                 for x, p in zip(asked.column("lang").to_pylist(), asked.column("part").to_pylist(), strict=True)]
        for raw in blocks.column("block").to_pylist() if paths else []:
            f += Automaton.load(raw).weights(paths)
        return pa.table({"lang": asked.column("lang"), "part": asked.column("part"), "f": pa.array(f)})
    return run


def part_weights(blocks: DataFrame, parts: DataFrame, bounds: list[Path], max_words: int) -> DataFrame:
    """(lang, part, f) of every different (lang, part)."""
    asked = parts.select("lang", "part").distinct().mapInArrow(_deal(bounds), "range int, lang string, part string")
    got = blocks.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(_compose(max_words + 1), "lang string, part string, f long")
    return got.groupBy("lang", "part").agg(F.sum("f").alias("f"))


def _joined(a: Column | str, b: Column | str) -> Column:
    return F.array_join(F.slice("words", a, b), " ")


def mine(docs: DataFrame, *, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside_pct: int = 50, top: int = TOP,
         range_bytes: int = RANGE_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top``
    phrases of 2 to ``max_words`` words. A phrase goes if a longer candidate
    holds it and has ``inside_pct`` of 100 of its count."""
    C.prepare(docs.sparkSession)
    docs = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    bounds = range_bounds(docs, max_words, range_bytes)
    blocks = count_blocks(docs, bounds, max_words=max_words, min_count=min_count, shard_words=shard_words).checkpoint()
    counted = totals(blocks).checkpoint()
    words = counted.where("size = 0").select("lang", F.col("f").alias("n"))
    found = counted.where((F.col("size") >= 2) & (F.col("f") >= min_count)).select("lang", "phrase", "size", F.col("f").alias("a"))

    cut = (found.select("lang", "phrase", "a", "size", F.split("phrase", " ").alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
           .select("lang", "phrase", "a", "k", _joined(1, F.col("k")).alias("first"), _joined(F.col("k") + 1, F.col("size")).alias("rest")))
    f = part_weights(blocks, cut.select("lang", F.explode(F.array("first", "rest")).alias("part")), bounds, max_words).checkpoint()
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    scored = (cut.join(f.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(f.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .withColumn("top", F.lit(1_000_000).cast("decimal(38,0)") * exact("a") * exact("a"))
              .withColumn("bottom", exact("l") * exact("r"))
              .withColumn("score", F.expr("top div bottom"))
              .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")))

    longer = found.where("size > 2").withColumn("words", F.split("phrase", " "))
    size = F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m")
    inner = (longer.select("lang", "a", "words", "size", size)
             .select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i"))
             .select("lang", "a", _joined(F.col("i"), F.col("m")).alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = (scored.join(inner, ["lang", "phrase"], "left").where(F.expr(f"most IS NULL OR 100 * most < {inside_pct} * a"))
            .select("lang", "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt")))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
