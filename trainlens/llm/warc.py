"""WARC archives with a salvage reader.

Writing: every page becomes a record of its own gzip member; records with
equal payloads are revisits of the one with the largest page id, once the
payload has ``min_revisit`` bytes. Archives are rows (path, content) of a table
in the shared folder, ``content`` being a complete ``.warc.gz`` file; the same
columns come from ``spark.read.format("binaryFile")`` over archive files, so
the reader takes either.

Reading: a member is believed after its checks (gzip checksum and size, a
version line, a header block, a body of the stated length, the stated block
digest). After a failed check the reader looks for the next place where a
record can start, the next gzip member that passes them or the next version
line in uncompressed data, goes on from there, and reports the bytes between
as a quarantined gap with the reason. Records behind damage are so recovered.
A member of several records is searched the same way inside, in as much of it
as decompresses; the gaps within it carry the member's offset and name their
bytes of the decompressed data. If the member fails gzip's checks otherwise than
by a missing end, its records need a block digest that fits, and a member's only
record is believed with those checks alone, which are its own.

Defined results: null html is an empty payload; a null url is written without a
target; a null page_id is smaller than any other; pages whose page_id equals
the largest of their payload are all responses; repeated rows are written each;
extra columns are ignored; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlens.llm import common as C
from trainlens.session import ensure_checkpoint_dir

VERSION = b"WARC/1.1\r\n"
START = re.compile(rb"WARC/\d\.\d\r?\n")
MEMBER = b"\x1f\x8b\x08"
NO_END = "gzip member without an end"
STEP = 64 << 10  # compressed bytes at a time
ARCHIVE_BYTES = 4 << 20  # payload bytes of an archive, about
DATE = "1970-01-01T00:00:00Z"  # pages carry no date


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    body: bytes


@dataclass
class Reading:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # start, end, reason


class Damage(Exception):
    """A check that failed."""


def record_bytes(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. ``refers_to`` makes it a revisit."""
    kind = "response" if refers_to is None else "revisit"
    body = payload if refers_to is None else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"), ("WARC-Date", DATE),
            ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
            ("WARC-Block-Digest", f"sha1:{digest(body)}")]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(body))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: headers, body, and the place behind it."""
    m = START.match(raw, at)
    if not m:
        raise Damage("no version line")
    end = raw.find(b"\r\n\r\n", m.end() - 2)
    if end < 0:
        raise Damage("header block without an end")
    headers: dict[str, str] = {}
    for line in raw[m.end():end].split(b"\r\n"):
        if not line:
            continue
        name, sep, value = line.partition(b":")
        if not sep or START.match(name):
            raise Damage("malformed header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not headers.get("content-length", "").isdigit():
        raise Damage("no valid Content-Length")
    a = end + 4
    b = a + int(headers["content-length"])
    if raw[b:b + 4] != b"\r\n\r\n":
        raise Damage("body does not end where Content-Length says")
    body = raw[a:b]
    block = headers.get("warc-block-digest", "")
    if block.startswith("sha1:") and block[5:].upper() != digest(body):
        raise Damage("block digest differs")
    return headers, body, b + 4


def _member_at(data: bytes, at: int) -> tuple[bytes, int]:
    """The decompressed member at ``at`` and the place behind it."""
    # step by step: a decompressor copies all it is fed and doesn't use
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    for a in range(at, len(data), STEP):
        try:
            out.append(z.decompress(view[a:a + STEP]))
        except zlib.error as e:
            raise Damage(f"gzip: {str(e)[:60]}") from e
        if z.eof:
            return b"".join(out), min(a + STEP, len(data)) - len(z.unused_data)
    raise Damage(NO_END)


def _member_prefix(data: bytes, at: int) -> bytes:
    """What comes out of the broken member at ``at`` before the damage shows."""
    z, out = zlib.decompressobj(31), []
    for a in range(at, len(data), STEP):
        part = data[a:a + STEP]
        before = z.copy()
        try:
            out.append(z.decompress(part))
        except zlib.error:
            try:
                for k in range(len(part)):
                    out.append(before.decompress(part[k:k + 1]))
            except zlib.error:
                pass
            break
        if z.eof:
            break
    return b"".join(out)


def _consumed(data: bytes, at: int, size: int) -> int:
    """The place behind the bytes that give the first ``size`` of a member, but
    for the last of them, behind which the checks would follow."""
    z, made = zlib.decompressobj(31), 0
    for a in range(at, len(data), STEP):
        part = data[a:a + STEP]
        made += len(z.decompress(part, size - 1 - made))
        if made >= size - 1:
            return a + len(part) - len(z.unconsumed_tail)
    return len(data)


def _salvage(raw: bytes, at: int, proof: bool = False) -> tuple[list[Record], list[tuple[int, int, str]], int]:
    """Records in the decompressed bytes of the member at ``at``, the gaps
    between them (places in those bytes) and the end of the last record. With
    ``proof`` a record needs a block digest."""
    found, gaps, inner, bad, why, last = [], [], 0, None, "", 0
    while inner < len(raw):
        try:
            headers, body, behind = parse_record(raw, inner)
            if proof and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damage("no block digest in a damaged member")
        except Damage as e:
            if bad is None:
                bad, why = inner, str(e)
            m = START.search(raw, inner + 1)
            inner = m.start() if m else len(raw)
            continue
        if bad is not None:
            gaps.append((bad, inner, why))
            bad = None
        found.append(Record(at, headers, body))
        inner = last = behind
    if bad is not None:
        gaps.append((bad, len(raw), why))
    return found, gaps, last


def _inside(at: int, end: int, gaps: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Gaps within the member at ``at`` as gaps of the archive."""
    return [(at, end, f"{why} (bytes {a} to {b} of the decompressed member)") for a, b, why in gaps]


def read_archive(data: bytes) -> Reading:
    """All records that pass the checks, and the gaps between them."""
    out, at, bad, why = Reading(), 0, None, ""
    while at < len(data):
        try:
            if data.startswith(MEMBER, at):
                try:
                    raw, behind = _member_at(data, at)
                except Damage as e:
                    raw = _member_prefix(data, at)
                    found, gaps, last = _salvage(raw, at, proof=str(e) != NO_END)
                    # the only record of a member stands and falls with it
                    if not found or (len(found) == 1 and last == len(raw) and not gaps):
                        raise
                    if bad is not None:
                        out.gaps.append((bad, at, why))
                    resume = max(at + 1, _consumed(data, at, last))
                    out.records += found
                    out.gaps += _inside(at, resume, gaps)
                    bad, why, at = at, str(e), _next_start(data, resume)
                    continue
                found, gaps, _ = _salvage(raw, at)
                if not found and gaps:
                    if bad is None:
                        bad, why = at, gaps[0][2]
                    at = behind
                    continue
                if found and bad is not None:
                    out.gaps.append((bad, at, why))
                    bad = None
                out.gaps += _inside(at, behind, gaps)
            else:
                headers, body, behind = parse_record(data, at)
                found = [Record(at, headers, body)]
            if not found:
                raise Damage("empty member")
        except Damage as e:
            if bad is None:
                bad, why = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if bad is not None:
            out.gaps.append((bad, at, why))
            bad = None
        out.records += found
        at = behind
    if bad is not None:
        out.gaps.append((bad, len(data), why))
    return out


def _next_start(data: bytes, at: int) -> int:
    """The next place where a member or a version line begins."""
    gz = data.find(MEMBER, at)
    m = START.search(data, at)
    places = [x for x in (gz, m.start() if m else -1) if x >= 0]
    return min(places, default=len(data))


def _build(archive_bytes: int):
    """Archives of about ``archive_bytes`` payload bytes from the pages of a
    task; a larger payload has one of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, out, held = TaskContext.get().partitionId(), 0, bytearray(), 0

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{task:05d}-{count:06d}.warc.gz"]), pa.array([bytes(out)], pa.binary())], ["path", "content"])
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html", "leader")]
            for page_id, url, html, leader in zip(*cols, strict=True):
                payload = (html.as_py() or "").encode()
                out += member(record_bytes(page_id.as_py(), url.as_py(), payload, digest(payload), leader.as_py()))
                held += len(payload)
                if held >= archive_bytes:
                    yield archive()
                    count, held = count + 1, 0
                    out.clear()
        if out:
            yield archive()
    return run


def write(pages: DataFrame, path: str, *, min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as a table of archives. Payloads
    are shuffled once, to meet their copies; a task writes what it then has."""
    C.prepare(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    p = p.withColumn("key", F.sha2(F.coalesce("html", F.lit("")), 256)).withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)))
    lead = p.where(F.col("size") >= min_revisit).groupBy("key").agg(F.max("page_id").alias("most"), F.count("*").alias("n")).where("n > 1")
    leader = F.when(~F.col("page_id").eqNullSafe(F.col("most")), F.col("most"))
    (p.join(lead.select("key", "most"), "key", "left").select("page_id", "url", "html", leader.alias("leader"))
     .mapInArrow(_build(archive_bytes), "path string, content binary")
     .write.option("compression", "none").parquet(path))


READ_SCHEMA = ("path string, offset long, gap_end long, gap_reason string, record_type string, page_id long, "
               "refers_to long, url string, payload_digest string, payload_bytes long, payload binary")


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    number = lambda s: int(s) if s and s.lstrip("-").isdigit() else None
    for b in batches:
        for path, content in zip(b.column(b.schema.get_field_index("path")).to_pylist(), b.column(b.schema.get_field_index("content")), strict=True):
            got = read_archive(content.as_py() or b"")
            rows: list[tuple] = [(path, a, e, why, None, None, None, None, None, None, None) for a, e, why in got.gaps]
            for r in got.records:
                h = r.headers
                rows.append((path, r.offset, None, None, h.get("warc-type"), number(h.get("warc-page-id")), number(h.get("warc-refers-to-page-id")),
                             h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:").upper() or None,
                             len(r.body), r.body if with_payload else None))
            for i in range(0, len(rows), 2000):
                part = rows[i:i + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)


def read(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``gap_end`` not null) of all archives."""
    C.prepare(archives.sparkSession)
    return archives.select("path", "content").mapInArrow(lambda batches: _read(batches, with_payload), READ_SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the
    records; a revisit takes its size from the response it refers to, which
    must have the same digest."""
    r = records.where("gap_end IS NULL AND record_type IN ('response', 'revisit')")
    r = r.select("page_id", "record_type", "refers_to", "payload_digest", F.col("payload_bytes").alias("size"))
    whole = (r.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
             .agg(F.max("size").alias("payload_bytes")))
    again = r.where("record_type = 'revisit'").join(whole, ["refers_to", "payload_digest"], "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (r.where("record_type = 'response'").withColumn("payload_bytes", F.col("size")).withColumn("refers_to", F.lit(None).cast("long"))
            .select(*cols).unionByName(again.select(*cols)))


def round_trip(pages: DataFrame, *, min_revisit: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_revisit=min_revisit)
    return resolve(read(spark.read.parquet(path), with_payload=False))
