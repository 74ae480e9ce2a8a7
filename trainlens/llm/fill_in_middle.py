"""Fill-in-middle transformation over content-defined chunks.

A text of n code points is cut at two drawn places into prefix, middle and
suffix, which are written in another order between sentinels:

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text as it is

Where a cut lies in bytes is found through chunks. A rolling hash of the last
``WINDOW`` bytes ends a chunk, so passages that documents share fall into the
same chunks wherever they stand. A chunk's boundary summary -- code points that
start in it, whether it holds a sentinel, its first and last two bytes -- is
computed once and kept in a bounded cache per worker whose keys are the chunks
themselves, so a hit is an equal chunk and not an equal hash. Summaries combine
from left to right: the counts' running sum finds the chunk of a cut, the outer
bytes of neighbours show a sentinel that lies across them, and only the two
chunks with the cuts are looked into. The cache changes no result: a lost
executor's tasks run again elsewhere with an empty one.

One narrow pass, no shuffle. Draws come from sha256 of seed, ``:`` and doc_id,
so every run and every partitioning gives the same cuts.

Defined results: a null text counts as empty and stays plain, as does a text
that holds a sentinel; a null doc_id is drawn from as the empty string;
repeated rows are transformed alike; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlens.llm import common as C

SENTINELS = ("<P>", "<S>", "<M>")  # prefix, suffix, middle
WINDOW, MIN_CHUNK, MAX_CHUNK = 16, 64, 8192
CHUNK_BITS = 9  # a chunk ends about every 2**9 bytes
CACHE_BYTES = 48 << 20
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 12) for i in range(256)], np.uint32)
_BLOCK = 1 << 20


def _ends(buf: np.ndarray) -> np.ndarray:
    """Positions right behind which the rolling hash ends a chunk."""
    out = []
    for a in range(0, len(buf), _BLOCK):  # bounded temporaries for a giant text
        lo = max(0, a - WINDOW + 1)
        h = _GEAR[buf[lo:a + _BLOCK]]
        size, factor = 1, 0x9E3779B1
        while size < WINDOW and len(h) > size:  # hash of 1, 2, 4 .. bytes
            h = h[:-size] * np.uint32(factor) + h[size:]
            factor = factor * factor & 0xFFFFFFFF
            size *= 2
        if size == WINDOW:
            out.append(np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + lo + WINDOW)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def chunk_starts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of the chunks of all texts of a buffer. A chunk that is not its
    text's last has ``MIN_CHUNK`` bytes at least and none has more than
    ``MAX_CHUNK`` and ``MIN_CHUNK`` together."""
    first = np.unique(off[:-1][np.diff(off) > 0])
    if not len(first):
        return first
    ends = _ends(buf)
    own = np.searchsorted(first, ends, side="right") - 1
    # a cut counts if the window lies in the text and no other came shortly before
    ends = ends[(ends < len(buf)) & (ends - first[own] >= MIN_CHUNK)]
    ends = ends[np.diff(ends, prepend=-MIN_CHUNK) >= MIN_CHUNK]
    starts = np.union1d(first, ends)
    gap = np.diff(np.append(starts, len(buf)))
    more = np.maximum(0, (gap - MIN_CHUNK) // MAX_CHUNK)
    nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
    return np.union1d(starts, np.repeat(starts, more) + nth * MAX_CHUNK)


def _lead(buf: np.ndarray) -> np.ndarray:
    return (buf & 0xC0) != 0x80


class Summaries:
    """Boundary summaries of chunks, kept by content."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS, limit: int = CACHE_BYTES):
        self.marks = [s.encode() for s in sentinels]
        if len({len(m) for m in self.marks}) != 1 or len(self.marks[0]) != 3 or len({m[0] for m in self.marks} & {c for m in self.marks for c in m[1:]}):
            raise ValueError("sentinels are three ASCII characters whose first occurs nowhere else in them")
        self.known: dict[bytes, tuple[int, bool, int, int]] = {}
        self.size, self.limit = 0, limit
        self.hits = self.misses = 0

    def holds(self, *b: np.ndarray) -> np.ndarray:
        """Whether three byte columns spell a sentinel."""
        out = np.zeros(len(b[0]), bool)
        for m in self.marks:
            out |= (b[0] == m[0]) & (b[1] == m[1]) & (b[2] == m[2])
        return out

    def _summarize(self, chunks: list[bytes]) -> list[tuple[int, bool, int, int]]:
        buf = np.frombuffer(b"".join(chunks), np.uint8)
        off = np.append(0, np.cumsum([len(c) for c in chunks]))
        count = np.add.reduceat(_lead(buf).astype(np.int64), off[:-1])
        at = np.flatnonzero(self.holds(buf[:-2], buf[1:-1], buf[2:])) if len(buf) > 2 else np.zeros(0, np.int64)
        own = np.searchsorted(off, at, side="right") - 1
        marked = np.bincount(own[at + 3 <= off[own + 1]], minlength=len(chunks)) > 0
        word = lambda c: int.from_bytes(c.ljust(2, b"\0"), "big")
        return [(n, m, word(c[:2]), word(c[-2:])) for n, m, c in zip(count.tolist(), marked.tolist(), chunks, strict=True)]

    def of(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(code points, holds a sentinel, first two bytes, last two) per chunk."""
        o = np.append(starts, len(buf)).astype(np.int32)
        arr = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(buf))])
        d = arr.dictionary_encode()
        chunks = d.dictionary.to_pylist()
        got = [self.known.get(c) for c in chunks]
        new = [i for i, g in enumerate(got) if g is None]
        self.hits += len(starts) - len(new)
        self.misses += len(new)
        if new:
            for i, s in zip(new, self._summarize([chunks[i] for i in new]), strict=True):
                got[i] = s
                self.known[chunks[i]] = s
                self.size += len(chunks[i]) + 150
            while self.size > self.limit:  # the oldest go
                self.size -= len(old := next(iter(self.known))) + 150
                del self.known[old]
        return np.array(got, np.int64).reshape(-1, 4)[d.indices.to_numpy(zero_copy_only=False)]


_CACHE: dict[tuple[str, ...], Summaries] = {}


def cut_places(buf: np.ndarray, off: np.ndarray, cache: Summaries) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Code points of every text, whether it holds a sentinel, and a function
    from (texts, code points) to byte positions."""
    texts = len(off) - 1
    starts = chunk_starts(buf, off)
    s = cache.of(buf, starts) if len(starts) else np.zeros((0, 4), np.int64)
    own = np.searchsorted(off, starts, side="right") - 1
    total = np.append(0, np.cumsum(s[:, 0]))  # code points before every chunk
    chunk_of = np.searchsorted(starts, off)  # a text's first chunk
    n = total[chunk_of[1:]] - total[chunk_of[:-1]]
    marked = np.bincount(own[s[:, 1] > 0], minlength=texts) > 0
    if len(starts) > 1:
        a, b = np.divmod(s[:-1, 3], 256)
        c, e = np.divmod(s[1:, 2], 256)
        across = (cache.holds(a, b, c) | cache.holds(b, c, e)) & (own[:-1] == own[1:])
        marked |= np.bincount(own[:-1][across], minlength=texts) > 0

    ends = np.append(starts, len(buf))

    def byte_at(text: np.ndarray, point: np.ndarray) -> np.ndarray:
        out = off[1:][text].copy()  # behind the last code point
        inner = np.flatnonzero(point < n[text])
        goal = total[chunk_of[text[inner]]] + point[inner]
        chunk = np.searchsorted(total, goal, side="right") - 1
        for i, k, left in zip(inner.tolist(), chunk.tolist(), (goal - total[chunk]).tolist(), strict=True):
            x, y = ends[k], ends[k + 1]
            out[i] = x + np.flatnonzero(_lead(buf[x:y]))[left]
        return out
    return n, marked, byte_at


def _transform(sentinels: tuple[str, ...], plain_pct: int, spm_pct: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHE.setdefault(sentinels, Summaries(sentinels))
        p, s, m = cache.marks
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: B023, E731
            buf_all, off_all = C.buffer_of(col("text"))
            draws = [col(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
            for lo, hi in C.pieces(off_all):
                off = off_all[lo:hi + 1] - off_all[lo]
                buf = buf_all[off_all[lo]:off_all[hi]]
                n, marked, byte_at = cut_places(buf, off, cache)
                h1, h2, h3, h4 = (h[lo:hi] for h in draws)
                plain = (n == 0) | marked | (h3 % 100 >= 100 - plain_pct)
                spm = h4 % 100 < spm_pct
                x, y = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                cut = np.flatnonzero(~plain)
                at1, at2 = byte_at(cut, x[cut]), byte_at(cut, y[cut])
                raw = memoryview(buf.tobytes())
                out: list[bytes] = [b""] * (hi - lo)
                for i in np.flatnonzero(plain).tolist():
                    out[i] = raw[off[i]:off[i + 1]]
                for i, u, v in zip(cut.tolist(), at1.tolist(), at2.tolist(), strict=True):
                    pre, mid, suf = raw[off[i]:u], raw[u:v], raw[v:off[i + 1]]
                    out[i] = b"".join((s, suf, p, pre, m, mid) if spm[i] else (p, pre, s, suf, m, mid))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays(
                    [col("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(x, mask=plain),
                     pa.array(y - x, mask=plain), pa.array([bytes(o) for o in out], pa.binary()).cast(pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def transform(docs: DataFrame, *, seed: str = "1", plain_pct: int = 10, spm_pct: int = 20,
              sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.
    ``plain_pct`` of 100 texts stay plain, ``spm_pct`` of 100 others put the
    suffix first."""
    C.prepare(docs.sparkSession)
    Summaries(sentinels)  # raises on sentinels that cannot be told apart
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    base = docs.select("doc_id", "text", digest.alias("d")).select(
        "doc_id", "text", *[F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)])
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_transform(tuple(sentinels), plain_pct, spm_pct),
                           f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` of ``form`` was made of. A text that is cut holds
    no sentinel, and none can arise beside one, so every sentinel is found once."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = sentinels
    head = lambda c, mark: F.substring_index(c, mark, 1)
    rest = lambda mark: F.substring_index(out, mark, -1)
    psm = F.concat(head(rest(p), s), rest(m), head(rest(s), m))
    spm = F.concat(head(rest(p), m), rest(m), head(rest(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(out)
