"""Files whose records do not end at line breaks, read by byte ranges.

A JSON array or a CSV with line breaks inside quoted fields looks like one
value, but it can be cut anywhere if the state at the cut is known: inside a
string or not, and how deep. The text source deals a file into ranges (by a
separator byte that says nothing about structure, ``}`` or a line feed) and
every range is read by its own task:

1. each range reports what it does to the state, for either state it may be
   entered in: a small function, one row per range;
2. the functions are composed in file order, which gives every range the state
   it is entered in (one task, a few numbers in memory);
3. each range finds the records that lie in it; the pieces of a record that
   reaches over a cut, two or more per cut at most, are put together by a
   shuffle of those pieces only.

Records keep their order: a range's record count is added up over the ranges
before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainlens.functions.buffers import buffer_of

PLACE = ["path", "block"]
_PLACE = "path string, block long, size long"


def ranges_of(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(path, block, size, value): the pieces between separators, in file order
    within a range; ``block`` is where the range starts, ``size`` the file's."""
    scan = spark.read.option("lineSep", sep).text(path)
    return scan.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                       F.col("_metadata.file_size").alias("size"), "value")


def _by_range(batches: Iterator[pa.RecordBatch], sep: int) -> Iterator[tuple[tuple, dict, np.ndarray | None]]:
    """((path, block, size), first row's other columns, bytes with separators)
    piece by piece, and None as bytes where a range ends."""
    now, head = None, {}
    for b in batches:
        path, block, size = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        edge = np.append(np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (path[1:] != path[:-1]))), b.num_rows) if b.num_rows else [0]
        at = b.schema.get_field_index("value")
        for x, y in zip(edge[:-1], edge[1:], strict=True):
            key = (path[x], int(block[x]), int(size[x]))
            if key != now:
                if now is not None:
                    yield now, head, None
                now = key
                head = {n: b.column(i)[int(x)].as_py() for i, n in enumerate(b.schema.names) if i > 2 and i != at}
            buf, off = buffer_of(b.column(at).slice(int(x), int(y - x)))
            yield now, head, np.insert(buf, off[1:], sep)
    if now is not None:
        yield now, head, None


def _fold(rows: DataFrame, step: Callable[[tuple | None, dict], tuple], names: list[str], schema: str) -> DataFrame:
    """What each range is entered with: ``step(state, row)`` in file order, the
    state starting as None in every file. One small row per range."""
    cols = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["path"] != path:
                    path, state = r["path"], None
                state, entered = step(state, r)
                out.append((r["path"], r["block"], *entered))
            names_ = ["path", "block", *names]
            yield pa.RecordBatch.from_pylist([dict(zip(names_, o, strict=True)) for o in out], schema=pa.schema(
                [("path", pa.string()), ("block", pa.int64()), *[(n, pa.int64()) for n in names]]))
    return rows.select(*cols).repartition(1).sortWithinPartitions(*PLACE).mapInArrow(run, f"path string, block long, {schema}")


def _assemble(pieces: DataFrame) -> DataFrame:
    """(path, ordinal, text) of whole records from (path, block, rel, whole,
    text): ``rel`` counts the records begun in the range, 0 being the one it is
    entered in."""
    starts = pieces.groupBy(*PLACE).agg(F.max("rel").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = starts.select(*PLACE, (F.coalesce(F.sum("n").over(before), F.lit(0)) - 1).alias("shift"))
    placed = pieces.join(F.broadcast(shift), PLACE).withColumn("ordinal", F.col("rel") + F.col("shift"))
    whole = placed.where("whole").select("path", "ordinal", "text")
    cut = (placed.where("NOT whole").groupBy("path", "ordinal").agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("p"))
           .select("path", "ordinal", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    return whole.unionByName(cut)


_PIECE = pa.schema([("path", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("whole", pa.bool_()), ("text", pa.string())])
_PIECES = "path string, block long, rel long, whole boolean, text string"


class _Pieces:
    """Pieces of one range: text up to each cut, a record's number, and whether
    it began and ended here."""

    def __init__(self, key: tuple):
        self.path, self.block = key[:2]
        self.rel, self.rest, self.out = 0, b"", []

    def add(self, raw: bytes, closes: bool, opens: bool) -> None:
        """``raw`` belongs to the current record; after it the record may end
        and another begin."""
        self.rest += raw
        if closes or opens:
            self.flush(closes)
            self.rel += opens

    def flush(self, closed: bool) -> None:
        # records before the first cut and behind the last one go on elsewhere
        self.out.append((self.path, self.block, self.rel, closed and self.rel > 0, self.rest))
        self.rest = b""

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [[]] * 5
        self.out = []
        arrays = [pa.array(c, t) for c, t in zip(cols[:4], _PIECE.types[:4], strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(list(cols[4]), pa.binary()).cast(pa.string())], schema=_PIECE)


# ------------------------------------------------------------------ JSON
_OPEN, _SHUT = np.zeros(256, np.int64), np.zeros(256, bool)
_OPEN[[*b"[{"]], _OPEN[[*b"]}"]] = 1, -1


def _string_toggles(buf: np.ndarray) -> np.ndarray:
    """Quotes that are not escaped. An escape never reaches over a ``}``."""
    slash = buf == 0x5C
    at = np.arange(len(buf))
    last = np.maximum.accumulate(np.where(slash, -1, at))  # last byte that is no backslash
    run = np.append(0, (at - last)[:-1])  # backslashes right before
    return (buf == 0x22) & (run % 2 == 0)


def _json_effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether it toggles the string state, and what it adds to the
    depth if entered outside or inside a string."""
    parity, delta, n, first = 0, [0, 0], 0, -1
    for key, _, buf in _by_range(batches, 0x7D):
        if buf is None:
            yield pa.RecordBatch.from_pylist([{"path": key[0], "block": key[1], "size": key[2], "toggles": parity, "outside": delta[0], "inside": delta[1],
                                               "bytes": n, "first": first}])
            parity, delta, n, first = 0, [0, 0], 0, -1
            continue
        inside = (parity + np.cumsum(_string_toggles(buf))) % 2
        step = _OPEN[buf]
        delta = [delta[0] + int(step[inside == 0].sum()), delta[1] + int(step[inside == 1].sum())]
        if first < 0:
            marks = buf[~np.isin(buf, [*b" \t\r\n"])]
            first = int(marks[0]) if len(marks) else -1
        n += len(buf)
        parity = int(inside[-1]) if len(buf) else parity


def _json_state(state: tuple | None, r: dict) -> tuple[tuple, tuple]:
    inside, depth, root, seen = state or (0, 0, -1, 0)
    root = root if root >= 0 else r["first"]
    entered = (inside, depth, root, seen)
    return (inside ^ r["toggles"], depth + (r["inside"] if inside else r["outside"]), root, seen + r["bytes"]), entered


def _marks(buf: np.ndarray, head: dict, at: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Which bytes lie outside strings, the depth behind every byte, and the
    state behind the last."""
    inside = (at[0] + np.cumsum(_string_toggles(buf))) % 2
    outside = inside == 0
    depth = at[1] + np.cumsum(np.where(outside, _OPEN[buf], 0))
    return outside, depth, ((int(inside[-1]), int(depth[-1])) if len(buf) else at)


def _is_data_array(buf: np.ndarray, i: int) -> bool:
    head = buf[:i].tobytes().rstrip(b" \t\r\n")
    return head.endswith(b":") and head[:-1].rstrip(b" \t\r\n").endswith(b'"data"')


def _json_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range of an object document: the last member value opened or closed
    at depth one: 1 the ``data`` array is open, 0 it is not, -1 none."""
    at, last = None, -1
    for key, head, buf in _by_range(batches, 0x7D):
        if buf is None:
            yield pa.RecordBatch.from_pylist([{"path": key[0], "block": key[1], "last": last}])
            at, last = None, -1
            continue
        outside, depth, after = _marks(buf, head, at or (head["inside"], head["depth"]))
        events = np.flatnonzero(outside & (((buf == 0x5B) | (buf == 0x7B)) & (depth == 2) | (_OPEN[buf] < 0) & (depth == 1)))
        if len(events):
            i = int(events[-1])
            last = int(buf[i] == 0x5B and _is_data_array(buf, i))
        at = after


def _json_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, p, inside_array, base, closed = None, None, False, 1, False
    for key, head, buf in _by_range(batches, 0x7D):
        if p is None:
            at, p = (head["inside"], head["depth"]), _Pieces(key)
            base = 1 if head["root"] == 0x5B else 2
            inside_array = head["depth"] >= base and (base == 1 or head["open"] == 1)
        if buf is None:
            if inside_array:
                p.flush(False)
            yield p.batch()
            p = None
            continue
        outside, depth, at = _marks(buf, head, at)
        start = outside & (buf == 0x5B) & (depth == base)
        cut = outside & (((buf == 0x2C) & (depth == base)) | ((buf == 0x5D) & (depth == base - 1)))
        x = 0
        for i in np.flatnonzero(start | cut).tolist():
            if start[i]:
                if not inside_array and (base == 1 or _is_data_array(buf, i)):
                    inside_array, x = True, i + 1
                    p.rel += 1
            elif inside_array:
                more = buf[i] == 0x2C
                p.add(buf[x:i].tobytes(), True, bool(more))
                inside_array, x = bool(more), i + 1
        if inside_array:
            p.rest += buf[x:].tobytes()
        if len(p.out) > 10_000:
            yield p.batch()


def json_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(ordinal, elem) of every element of a JSON array, or of the array that
    is the member ``data`` of an object, as text; and (path, complete), whether
    each document is such a list and is closed. Ordinals run over all files in
    path order."""
    scan = ranges_of(spark, path, "}")
    effect = scan.mapInArrow(_json_effect, f"{_PLACE}, toggles long, outside long, inside long, bytes long, first long").checkpoint()
    state = _fold(effect, _json_state, ["inside", "depth", "root", "seen"], "inside long, depth long, root long, seen long").checkpoint()
    entered = scan.join(F.broadcast(state), PLACE)
    order = [*_PLACE.replace(" string", "").replace(" long", "").split(", "), "inside", "depth", "root", "value"]
    members = entered.where(f"root = {0x7B}").select(*order).mapInArrow(_json_members, "path string, block long, last long")

    def step(open_: int | None, r: dict) -> tuple[int, tuple]:
        now = open_ or 0
        return (now if r["last"] < 0 else r["last"]), (now,)
    opened = _fold(members, step, ["open"], "open long")
    known = entered.join(F.broadcast(opened), PLACE, "left").withColumn("open", F.coalesce("open", F.lit(0)))
    pieces = known.select(*order[:-1], "open", "value").mapInArrow(_json_pieces, _PIECES)
    rows = _assemble(pieces).where(F.length(F.trim(F.translate("text", "\t\r\n", "   "))) > 0)
    files = _ends(effect, state)
    counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    begun = pieces.where("rel > 0").select("path").distinct().withColumn("begun", F.lit(True))
    return (rows.join(F.broadcast(shift), "path").select((F.col("ordinal") + F.col("shift")).cast("long").alias("ordinal"), F.col("text").alias("elem")),
            files.join(begun, "path", "left").select("path", (F.col("closed") & F.coalesce("begun", F.lit(False))).alias("complete")))


def _ends(effect: DataFrame, state: DataFrame) -> DataFrame:
    """(path, closed): whether strings and brackets are closed at a file's end.
    The text source drops the last separator, whether or not the file has it:
    its size tells."""
    last = effect.join(state.select(*PLACE, F.col("inside").alias("was"), "depth", "seen"), PLACE)
    depth = F.col("depth") + F.when(F.col("was") == 1, F.col("inside")).otherwise(F.col("outside"))
    out = F.when(F.col("seen") + F.col("bytes") > F.col("size"), depth + 1).otherwise(depth)  # a } that isn't there
    ends = last.groupBy("path").agg(F.max_by(F.struct(out.alias("depth"), (F.col("was").bitwiseXOR(F.col("toggles"))).alias("open")), "block").alias("e"))
    return ends.select("path", ((F.col("e.depth") == 0) & (F.col("e.open") == 0)).alias("closed"))


# ------------------------------------------------------------------ CSV
def _line_end(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open behind a line. Quotes count where a field
    begins and inside a quoted one; elsewhere they are ordinary characters."""
    i, n = 0, len(line)
    while True:
        if inside:
            while True:
                i = line.find(b'"', i)
                if i < 0:
                    return True
                if line[i + 1:i + 2] == b'"':
                    i += 2
                    continue
                break
            i += 1
            inside = False
            i = line.find(b",", i)
        elif line[i:i + 1] == b'"':
            inside, i = True, i + 1
            continue
        else:
            i = line.find(b",", i)
        if i < 0 or i >= n:
            return False
        i += 1


def _lines(buf: np.ndarray) -> Iterator[bytes]:
    raw, at = buf.tobytes(), 0
    for end in np.flatnonzero(buf == 0x0A).tolist():
        yield raw[at:end]
        at = end + 1


def _csv_effect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether a quoted field is open behind it, by how it is entered."""
    end = [False, True]
    for key, _, buf in _by_range(batches, 0x0A):
        if buf is None:
            yield pa.RecordBatch.from_pylist([{"path": key[0], "block": key[1], "size": key[2], "outside": int(end[0]), "inside": int(end[1])}])
            end = [False, True]
            continue
        for line in _lines(buf):
            if b'"' in line:
                end = [_line_end(line, x) for x in end]


def _csv_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, inside = None, False
    for key, head, buf in _by_range(batches, 0x0A):
        if p is None:
            p, inside = _Pieces(key), bool(head["entered"])
        if buf is None:
            if p.rest:
                p.flush(False)
            yield p.batch()
            p = None
            continue
        for line in _lines(buf):
            if not inside:
                p.rel += 1
            inside = _line_end(line, inside) if b'"' in line else inside
            p.rest += line + b"\n"
            if not inside:
                p.flush(True)
        if len(p.out) > 10_000:
            yield p.batch()


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, ordinal, text) of every record, the header included, without its
    line break. Blank records count in ``ordinal`` and are left out."""
    scan = ranges_of(spark, path, "\n")
    effect = scan.mapInArrow(_csv_effect, f"{_PLACE}, outside long, inside long")

    def step(state: int | None, r: dict) -> tuple[int, tuple]:
        now = state or 0
        return (r["inside"] if now else r["outside"]), (now,)
    state = _fold(effect, step, ["entered"], "entered long").checkpoint()
    pieces = scan.join(F.broadcast(state), PLACE).select("path", "block", "size", "entered", "value").mapInArrow(_csv_pieces, _PIECES)
    rows = _assemble(pieces).withColumn("text", F.regexp_replace("text", "\r?\n$", ""))
    return rows.where("text <> ''")
