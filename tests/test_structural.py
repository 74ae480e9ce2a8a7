"""Arrays and quoted CSV read by byte ranges, against readers of whole files."""
import csv
import io as io_
import json
import os
from contextlib import contextmanager

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trainlens.sources import io
from trainlens.sources import structural as S

ROWS = [{"a": "x, y", "b": 1}, {"a": 'q"{[', "c": {"d": [1, {"e": "]}"}]}}, "text, with ] and }", 7, None, {"a": "\\", "b": "\\\"}"}, [1, [2]], {},
        {"a": "é漢\n", "b": None}, {"z": "\\\\"}]


@contextmanager
def cut_every(spark, n):
    keep = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        yield
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def write(folder, name, text):
    p = os.path.join(folder, name)
    with open(p, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return p


FORMS = {"compact": json.dumps(ROWS, separators=(",", ":")), "pretty": json.dumps(ROWS, indent=2, ensure_ascii=False),
         "wrapped": json.dumps({"meta": {"data": [1, {"x": 2}]}, "list": [3, [4]], "data": ROWS, "more": [{"data": [5]}]}),
         "wrapped_last": json.dumps({"n": "\"data\": [", "data": ROWS}, indent=1)}


def ranges(raw, cuts, sep):
    """What the text source hands to the tasks if a file is cut at ``cuts``: a
    piece belongs to the range it starts in."""
    edges = [0, *cuts, len(raw)]
    out, at, starts = [[] for _ in edges[1:]], 0, []
    parts = raw.split(sep)
    for k, part in enumerate(parts):
        if k < len(parts) - 1 or part:
            starts.append((at, part))
        at += len(part) + 1
    for at, part in starts:
        k = next(i for i, (x, y) in enumerate(zip(edges, edges[1:])) if (x < at <= y) or (i == 0 and at == 0))
        out[k].append(part.decode())
    return [(edges[k], out[k]) for k in range(len(out)) if out[k]]


def batch(size, block, values, **extra):
    n = len(values)
    cols = {"path": ["f"] * n, "block": [block] * n, "size": [size] * n, **{k: [v] * n for k, v in extra.items()}, "value": values}
    return [pa.RecordBatch.from_pydict(cols, schema=pa.schema([("path", pa.string()), *[(c, pa.int64()) for c in cols if c not in ("path", "value")], ("value", pa.string())]))]


def put_together(pieces):
    """Texts by ordinal, as _assemble does."""
    out, shift = {}, -1
    for part in pieces:
        for r in part:
            out[r["rel"] + shift] = out.get(r["rel"] + shift, "") + r["text"]
        shift += max((r["rel"] for r in part), default=0)
    return out


def rows_of(batches):
    return [r for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("form", sorted(FORMS))
def test_an_array_cut_at_every_byte(form):
    raw = FORMS[form].encode()
    for cut in range(1, len(raw)):
        parts = ranges(raw, [cut, *([cut + 5] if cut + 5 < len(raw) else [])], b"}")
        state, entered, member, opened = None, [], None, []
        for block, values in parts:
            r = rows_of(S._json_effect(iter(batch(len(raw), block, values))))[0]
            state, now = S._json_state(state, r)
            entered.append(dict(zip(("inside", "depth", "root", "seen"), now, strict=True)))
        for (block, values), e in zip(parts, entered, strict=True):
            opened.append(member or 0)
            last = rows_of(S._json_members(iter(batch(len(raw), block, values, inside=e["inside"], depth=e["depth"], root=e["root"]))))[0]["last"]
            member = member if last < 0 else last
        got = put_together(rows_of(S._json_pieces(iter(batch(len(raw), block, values, inside=e["inside"], depth=e["depth"], root=e["root"], open=o))))
                           for (block, values), e, o in zip(parts, entered, opened, strict=True))
        assert [json.loads(got[k]) for k in sorted(got) if got[k].strip()] == ROWS, cut


def test_a_csv_cut_at_every_byte():
    raw = CSV.encode()
    whole = [r for r in csv.reader(io_.StringIO(CSV, newline="")) if r]
    for cut in range(1, len(raw)):
        parts = ranges(raw, [cut, *([cut + 4] if cut + 4 < len(raw) else [])], b"\n")
        state, pieces = 0, []
        for block, values in parts:
            r = rows_of(S._csv_effect(iter(batch(len(raw), block, values))))[0]
            pieces.append(rows_of(S._csv_pieces(iter(batch(len(raw), block, values, entered=state)))))
            state = r["inside"] if state else r["outside"]
        got = put_together(pieces)
        rows = [next(csv.reader(io_.StringIO(got[k], newline=""))) for k in sorted(got) if got[k].strip("\r\n")]
        assert rows == whole, cut


@pytest.mark.parametrize("form,size", [("compact", 9), ("pretty", 50), ("wrapped", 17), ("wrapped_last", 40), ("wrapped", 10**6)])
def test_elements_of_a_cut_array(spark, tmp_dir, form, size):
    p = write(tmp_dir, "d.json", FORMS[form])
    with cut_every(spark, size):
        rows, files = S.json_elements(spark, p)
        assert S.ranges_of(spark, p, "}").rdd.getNumPartitions() >= min(8, len(FORMS[form].encode()) // size)
        got = sorted((r.ordinal, json.loads(r.elem)) for r in rows.collect())
        assert [f.complete for f in files.collect()] == [True]
    assert got == list(enumerate(ROWS)) and [x for _, x in got] == ROWS


@pytest.mark.parametrize("text,complete", [("[]", True), (" [ \n ] ", True), ('{"data": []}', True), ('{"rows": [1]}', False), ("[1, 2", False),
                                           ('[{"a": 1}', False), ('{"data": [1]', False), ('{"data": 3}', False), ('"text"', False), ('[{"a": "x}', False)])
def test_documents_that_are_no_closed_list(spark, tmp_dir, text, complete):
    p = write(tmp_dir, "d.json", text)
    with cut_every(spark, 4):
        assert [f.complete for f in S.json_elements(spark, p)[1].collect()] == [complete]


def test_json_reader_equals_one_of_whole_files(spark, tmp_dir):
    p = write(tmp_dir, "d.json", FORMS["wrapped"])
    with cut_every(spark, 13):
        recs, viol = io.read_json_dataset(spark, p)
        got = {r.ordinal: r.record for r in recs.collect()}
        bad = sorted((v.ordinal, v.reason) for v in viol.collect())
    text = spark.read.text(p, wholetext=True).select(F.from_json(F.get_json_object("value", "$.data"), "array<string>").alias("a"))
    whole = text.select(F.posexplode("a").alias("i", "e")).where("json_object_keys(e) IS NOT NULL").select(
        "i", F.transform_values(F.from_json("e", "map<string,string>"), lambda k, v: F.coalesce(v, F.lit(""))).alias("m"))
    assert got == {r.i: r.m for r in whole.collect()}
    assert bad == [(i, f"Invalid dataset row at index {i}: row must be a JSON object") for i, r in enumerate(ROWS) if not isinstance(r, dict)]


CSV = ('id,text,n\n1,"a ""quoted"" word",x\n2,"line\nbreak, and\r\n\n""more""",y\n\n3,plain "q" inside,z\n4,,\n5,"",""\n6,"a,b",\'\n7,é漢,"\n"\n'
       '8,"end"')


@pytest.mark.parametrize("text,size", [(CSV, 6), (CSV + "\n", 31), (CSV, 10**6), ("id,text\n", 3), ("a\n\n\n1\n", 2), ('a,b\n"x\n\n\n\n\n\n\n","y"\n1,2\n', 3)])
def test_quoted_csv_equals_the_whole_file_reader(spark, tmp_dir, text, size):
    p = write(tmp_dir, "d.csv", text)
    whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(p)
    expected = [tuple(x or "" for x in r) for r in whole.collect()]
    with cut_every(spark, size):
        got = io.read_csv_dataset(spark, p)
        rows = got.orderBy("ordinal").collect()
    assert got.columns == [*whole.columns, "ordinal"]
    assert [tuple(r)[:-1] for r in rows] == expected and [r.ordinal for r in rows] == list(range(len(expected)))


def test_several_files_keep_path_order(spark, tmp_dir):
    for k in range(3):
        write(tmp_dir, f"f{k}.csv", "id,t\n" + "".join(f'{10 * k + i},"l\n{i}"\n' for i in range(4)))
        write(tmp_dir, f"f{k}.json", json.dumps([{"id": 10 * k + i} for i in range(4)]))
    with cut_every(spark, 30):
        rows = io.read_csv_dataset(spark, os.path.join(tmp_dir, "*.csv")).orderBy("ordinal").collect()
        assert [int(r.id) for r in rows] == [10 * k + i for k in range(3) for i in range(4)]
        recs = io.read_json_dataset(spark, os.path.join(tmp_dir, "*.json"))[0].orderBy("ordinal").collect()
        assert [int(r.record["id"]) for r in recs] == [10 * k + i for k in range(3) for i in range(4)] and [r.ordinal for r in recs] == list(range(12))


def test_line_breaks_inside_fields_stay_as_they_are(spark, tmp_dir):
    text = 'a,b\r\n"x\r\ny",1\r\n2,"z\n"\r\n'
    with cut_every(spark, 5):
        rows = io.read_csv_dataset(spark, write(tmp_dir, "d.csv", text)).orderBy("ordinal").collect()
    assert [[r.a, r.b] for r in rows] == list(csv.reader(io_.StringIO(text, newline="")))[1:]
