"""Best-fit packing by linear grouping.

Texts become token ids and, if longer than a sequence, pieces of it. What is
planned is the histogram of piece lengths, at most ``capacity`` numbers however
many documents there are; documents never pass through the driver.

* Large lengths (over ``small``) are cut into ``groups`` of equal cardinality
  and rounded up to their group's largest.
* Configurations of the few sizes left are optimised: the largest size with
  pieces left and the multiset of the others that fills its sequence best
  (a subset-sum over the sizes, larger ones preferred) is used as often as its
  sizes last.
* The configurations' slots get actual lengths back, which only frees room.
* Small lengths go, largest first, where they leave least room.

The number of groups and what counts as small are tried at several values; the
plan with the fewest sequences is taken (a plan takes milliseconds, whatever the
corpus).

The plan says, for ranges of ranks within a length, which sequences they fill
and at which offset; pieces look theirs up. Ranks are counted per block of
documents and shifted by the counts of the blocks before, so a length that a
third of all pieces share is no task's burden.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null doc_id is an ordinary value; strings of special tokens in
a text are ordinary text; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainlens.llm import common as C

CAPACITY, END_ID = 1024, 2
BATCH_BYTES = 4 << 20
KNOWN, STEP = 400_000, 200  # cuts kept, cuts encoded at once


class Encoder:
    """Token ids of many texts. Byte-level pre-tokens never reach from a word
    into the white space after it, so texts are cut there, every different cut
    is encoded once, and the ids are put together again. Cuts met before stay in
    a table of ``KNOWN`` entries at most, the first and so mostly the frequent
    ones; it saves work and changes no ids. ``spec`` is the content of a tokenizers JSON
    file."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)  # a character of a byte-level token is one byte
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and each text's offset among them."""
        n = len(buf)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        sp = C.SPACE[buf]
        cut = np.zeros(n, bool)
        cut[1:] = sp[1:] & ~sp[:-1]
        # wide white space before the cut belongs to the same run as what follows
        p = np.flatnonzero(cut)
        wide = p[buf[p - 1] >= 0x80]
        for i in wide.tolist():
            if buf[max(0, i - 3):i].tobytes().decode("utf-8", "ignore")[-1:].isspace():
                cut[i] = False
        cut[off[:-1][off[:-1] < n]] = True
        s = np.flatnonzero(cut)
        o = np.append(s, n).astype(np.int32)
        arr = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(o), pa.py_buffer(np.ascontiguousarray(buf))])
        d = arr.dictionary_encode()
        cuts = d.dictionary.to_pylist()
        code_of = np.fromiter(map(self.known.get, cuts, repeat(-1)), np.int64, len(cuts))
        new = np.flatnonzero(code_of < 0)
        if len(self.known) + len(new) > KNOWN and 2 * len(new) > len(cuts):
            # full, and most cuts aren't in it: other texts than those it was made of
            self._forget()
            new = np.arange(len(cuts))
        ends, flat = self.ends, self.flat
        if len(new):
            fresh = [cuts[i] for i in new.tolist()]
            ids, count = self._encode_cuts(fresh)
            at = len(self.ends)
            code_of[new] = np.arange(at, at + len(new))
            ends, flat = np.append(ends, len(flat) + np.cumsum(count)), np.concatenate([flat, ids])
            room = max(0, KNOWN - len(self.known))  # beyond it, cuts are encoded and not kept
            self.known.update(zip(fresh[:room], range(at, at + len(new)), strict=False))
            self.ends = ends[:len(self.known)]
            self.flat = flat[:self.ends[-1]] if len(self.ends) else flat[:0]
        code = code_of[d.indices.to_numpy(zero_copy_only=False)]
        size = np.diff(ends, prepend=0)[code]
        upto = np.cumsum(size)
        pick = np.repeat(ends[code] - upto, size) + np.arange(int(upto[-1]))
        return flat[pick], np.append(0, upto)[np.searchsorted(s, off)]

    def _encode_cuts(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all cuts in turn, and each one's number of ids."""
        cuts = [c.decode() for c in raw]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        # cuts that begin with white space and end with a word can be encoded
        # one behind the other: tokens are bytes, so their lengths tell where
        # one cut ends; the others go alone
        joined = np.fromiter((x[0] in " \t\n\v\f\r" and not x[-1].isspace() for x in cuts), bool, len(cuts))
        inside, alone = np.flatnonzero(joined), np.flatnonzero(~joined)
        ids: list[np.ndarray] = []
        count = np.zeros(len(cuts), np.int64)
        groups = [inside[i:i + STEP] for i in range(0, len(inside), STEP)]
        for g, x in zip(groups, self._each(["".join([cuts[i] for i in g.tolist()]) for g in groups]), strict=True):
            ends = np.searchsorted(np.cumsum(self.bytes_of[x]), np.cumsum(sizes[g]))
            count[g] = np.diff(np.append(-1, ends))
            ids.append(x)
        for i, x in zip(alone.tolist(), self._each([cuts[i] for i in alone.tolist()]), strict=True):
            count[i] = len(x)
            ids.append(x)
        order = np.concatenate([inside, alone])
        flat = np.concatenate(ids)
        at = np.zeros(len(cuts), np.int64)
        at[order] = np.cumsum(count[order]) - count[order]
        ends = np.cumsum(count)
        return flat[np.repeat(at - (ends - count), count) + np.arange(len(flat))], count


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    """One tokenizer per worker process; building one takes memory that the
    process doesn't give back."""
    return Encoder(spec)


def _cut(spec: str, capacity: int, end_id: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(spec)
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            doc = b.column(b.schema.get_field_index("doc_id"))
            buf, off = C.buffer_of(b.column(b.schema.get_field_index("text")))
            for lo, hi in C.pieces(off, BATCH_BYTES):
                ids, io = enc.encode(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                ids = ids.astype("<u4")
                rows: list[tuple[int, int, int, int, int]] = []
                kept: list[bytes] = []
                for i, (x, y) in enumerate(zip(io[:-1].tolist(), io[1:].tolist(), strict=True)):
                    raw = ids[x:y].tobytes() + end
                    total = y - x + 1
                    first = total % capacity or capacity
                    at, k = 0, 0
                    while at < total:
                        size = first if k == 0 else capacity
                        part = raw[4 * at:4 * (at + size)]
                        rows.append((lo + i, k, at, size, zlib.crc32(part)))
                        if with_ids:
                            kept.append(part)
                        at += size
                        k += 1
                r = np.array(rows, np.int64).reshape(-1, 5)
                cols = [doc.take(pa.array(r[:, 0])), pa.array(r[:, 1].astype(np.int32)), pa.array(r[:, 2]), pa.array(r[:, 3]), pa.array(r[:, 4])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(kept), "<u4").astype(np.int32))
                    o = np.append(0, np.cumsum(r[:, 3])).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(o), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)
    return cut


def tokenize(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece.
    ``tokenizer`` is the path of a byte-level tokenizers JSON file; only the
    driver reads it."""
    spec = Path(tokenizer).read_text(encoding="utf-8")
    base = docs.select("doc_id", "text")
    return base.mapInArrow(_cut(spec, capacity, end_id, with_ids),
                           f"doc_id {base.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
                           + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY, *, groups: int = 64, small: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) rows: the ranks
    [r, r + n) of a length go to the sequences [s, s + n), one each."""
    rows: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left -> (first sequence, sequences, offset)
    seq = 0

    def put(length: int, n: int, s: int, offset: int) -> None:
        rows.append((length, used[length], n, s, offset))
        used[length] += n

    # linear grouping of the large lengths
    large = [(x, counts[x]) for x in sorted(counts, reverse=True) if x > small and counts[x]]
    total = sum(n for _, n in large)
    each = -(-total // groups) if total else 1
    queue: list[list[list[int]]] = []
    free = 0
    for x, n in large:
        while n:
            if not free:
                queue.append([])
                free = each
            take = min(n, free)
            queue[-1].append([x, take])
            n, free = n - take, free - take
    # groups that round to one size are one size to the configurations
    size: list[int] = []
    merged: list[list[list[int]]] = []
    for g in queue:
        if size and g[0][0] == size[-1]:
            merged[-1] += g
        else:
            size.append(g[0][0])
            merged.append(g)
    left = [sum(n for _, n in g) for g in merged]
    head = 0
    while True:
        while head < len(size) and not left[head]:
            head += 1
        if head == len(size):
            break
        config = _best_fill(size, left, head, capacity)
        times = min(left[g] // m for g, m in config)
        slots = []
        for g, m in config:
            left[g] -= m * times
            for _ in range(m):
                need, slot = times, []
                while need:
                    run = merged[g][0]
                    take = min(need, run[1])
                    slot.append([run[0], take])
                    run[1] -= take
                    need -= take
                    if not run[1]:
                        merged[g].pop(0)
                slots.append(slot)
        done = 0
        while done < times:  # sequences with the same actual lengths
            step, offset = min(s[0][1] for s in slots), 0
            for s in slots:
                put(s[0][0], step, seq + done, offset)
                offset += s[0][0]
                s[0][1] -= step
                if not s[0][1]:
                    s.pop(0)
            if capacity > offset:
                room.setdefault(capacity - offset, []).append((seq + done, step, offset))
            done += step
        seq += times
    # best fit of the small lengths
    for x in sorted((x for x in counts if x <= small), reverse=True):
        n = counts[x]
        while n:
            r = min((r for r in room if r >= x and room[r]), default=None)
            if r is None:
                fresh = -(-n // (capacity // x))
                room.setdefault(capacity, []).append((seq, fresh, 0))
                seq += fresh
                continue
            s, bins, offset = room[r].pop()
            per = r // x
            full = min(bins, n // per)
            for j in range(per if full else 0):
                put(x, full, s, offset + j * x)
            n -= full * per
            if full and r - per * x:
                room.setdefault(r - per * x, []).append((s, full, offset + per * x))
            s, bins = s + full, bins - full
            if n and bins:  # fewer pieces than one sequence takes
                for j in range(n):
                    put(x, 1, s, offset + j * x)
                if r - n * x:
                    room.setdefault(r - n * x, []).append((s, 1, offset + n * x))
                s, bins, n = s + 1, bins - 1, 0
            if bins:
                room[r].append((s, bins, offset))
    return rows


def _best_fill(size: list[int], left: list[int], head: int, capacity: int) -> list[tuple[int, int]]:
    """(size index, times): the largest size and the multiset of sizes still
    there that brings its sequence closest to full."""
    space = capacity - size[head]
    reach, steps = 1, []  # bit c: c can be filled
    mask = (1 << (space + 1)) - 1
    for g in range(head, len(size)):
        have = min(left[g] - (g == head), space // size[g])
        if have <= 0:
            continue
        steps.append((g, have, reach))
        for _ in range(have):
            reach |= (reach << size[g]) & mask
        if reach >> space & 1:
            break
    fill = reach.bit_length() - 1
    out = {head: 1}
    for g, have, before in reversed(steps):
        k = 0
        while not before >> fill & 1:
            fill -= size[g]
            k += 1
        if k:
            out[g] = out.get(g, 0) + k
    return list(out.items())


def best_plan(counts: dict[int, int], capacity: int, groups: int | tuple[int, ...], small: tuple[int, ...]) -> list[tuple[int, int, int, int, int]]:
    tried = (groups,) if isinstance(groups, int) else groups
    plans = [plan(counts, capacity, groups=g, small=x) for g in tried for x in small]
    return min(plans, key=lambda rows: max((s + n for _, _, n, s, _ in rows), default=0))


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, groups: int | tuple[int, ...] = (64, 256, 1000),
         small: tuple[int, ...] = (64, 128, 256, 384, 512)) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset."""
    spark = pieces.sparkSession
    C.prepare(spark)
    parts = C.shuffle_partitions(spark)
    pieces = pieces.withColumn("part", C.bucket(F.struct("doc_id", "piece"), parts)).checkpoint()
    here = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    hist = {r["length"]: r["n"] for r in here.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = best_plan(hist, capacity, groups, small)
    table = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, first long, n long, s long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = here.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (pieces.withColumn("rank", F.row_number().over(own) - 1).join(shift, ["length", "part"])
              .withColumn("rank", F.col("rank") + F.col("shift")).drop("part", "shift"))
    # the plan's size depends on the capacity and the groups only
    t = F.broadcast(table.withColumnRenamed("length", "len"))
    return (ranked.join(t, (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
            .withColumn("sequence_id", F.col("s") + F.col("rank") - F.col("first"))
            .withColumn("offset", F.col("at")).drop("rank", "len", "first", "n", "s", "at"))
