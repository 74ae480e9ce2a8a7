"""A gradient store of chunks, written as one transaction.

One job goes from train rows to the store: the seeded subset (C10), its
gradients (V07), the sampled coordinates (V02), and chunks of ``chunk_rows``
rows in subset order. A Python data source writes it: every task writes whole
chunk files under a name of their own and hands in what it wrote; the commit
puts row ranges, sizes, dtype, tensor names and coordinates into one manifest.
Without a manifest nothing can be read, so a run that dies leaves no half store.

A chunk file appears under its final name only once it is complete, and its
name holds the plan it belongs to. A later run of the same plan (same ids in the
same order, same settings) writes the missing chunks only.

Readers take the manifest's chunks and leave out those whose rows they don't
need.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trainlens.functions.files import open_fs
from trainlens.operators.splits import gradient_subset
from trainlens.operators.vectors import gather
from trainlens.plans.ordinal import with_ordinal

CHUNK_ROWS = 512
MANIFEST = "manifest.json"


@dataclass
class ChunkMessage(WriterCommitMessage):
    chunks: list[dict]


def _chunk_name(plan: str, chunk: int) -> str:
    return f"chunk-{plan[:12]}-{chunk:08d}.parquet"


class GradientStoreSource(DataSource):
    """``df.write.format("gradient_store")`` of rows (chunk, pos, idx, grad,
    loss), a chunk's rows together and in order."""

    @classmethod
    def name(cls) -> str:
        return "gradient_store"

    def writer(self, schema, overwrite: bool) -> GradientStoreWriter:
        return GradientStoreWriter(dict(self.options))


class GradientStoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.plan, self.meta = options["path"], options["plan"], options["meta"]

    def write(self, iterator) -> ChunkMessage:
        done, now, held = [], None, []
        for batch in iterator:
            chunk = batch.column(batch.schema.get_field_index("chunk")).to_numpy()
            a = 0
            while a < len(chunk):
                b = a + int((chunk[a:] == chunk[a]).sum())
                if chunk[a] != now and held:
                    done.append(self._put(now, held))
                    held = []
                now = int(chunk[a])
                held.append(batch.slice(a, b - a))
                a = b
        if held:
            done.append(self._put(now, held))
        return ChunkMessage(done)

    def _put(self, chunk: int, batches: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(batches).drop_columns(["chunk"])
        where, folder = open_fs(self.path)
        name = _chunk_name(self.plan, chunk)
        hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
        pq.write_table(t, hidden, filesystem=where)
        where.move(hidden, f"{folder}/{name}")  # complete files only have the final name
        return {"chunk": chunk, "file": name}

    def commit(self, messages: list[ChunkMessage | None]) -> None:
        """The manifest, from the chunk files of this run and of earlier ones."""
        where, folder = open_fs(self.path)
        meta = json.loads(self.meta)
        written = {c["chunk"] for m in messages if m for c in m.chunks}
        chunks = []
        for i in range(-(-meta["rows"] // meta["chunk_rows"])):
            name = _chunk_name(self.plan, i)
            size = where.get_file_info(f"{folder}/{name}").size
            if size is None:
                raise RuntimeError(f"{name} is missing: the store stays as it was")
            first = i * meta["chunk_rows"]
            chunks.append({"file": name, "first": first, "rows": min(meta["chunk_rows"], meta["rows"] - first), "file_bytes": size, "written": i in written})
        raw = json.dumps({**meta, "plan": self.plan, "chunks": chunks}, sort_keys=True).encode()
        hidden = f"{folder}/.{MANIFEST}.{uuid.uuid4().hex}"
        with where.open_output_stream(hidden) as f:
            f.write(raw)
        where.move(hidden, f"{folder}/{MANIFEST}")

    def abort(self, messages: list[ChunkMessage | None]) -> None:
        """Complete chunks stay for the next run; parts of chunks go."""
        from pyarrow import fs
        where, folder = open_fs(self.path)
        for info in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if info.base_name.startswith(".chunk-"):
                where.delete_file(info.path)


def write_gradient_store(train: DataFrame, path: str, *, k: int, coords: list[int], tensors: list[tuple[str, int]] = (),
                         chunk_rows: int = CHUNK_ROWS, seed: int = 2026, grads=None) -> dict:
    """Writes the store of ``train`` (idx, grad, loss) and returns its manifest.
    ``grads`` makes (idx, grad, loss) from the subset's rows where ``train`` has
    no gradients yet (for example by ``vectors.gradients_with``). ``tensors`` are
    the names and sizes of the tensors that the coordinates come from. The
    manifest of an earlier plan is replaced at the commit."""
    spark = train.sparkSession
    spark.dataSource.register(GradientStoreSource)
    where, folder = open_fs(path)
    where.create_dir(folder, recursive=True)
    subset = gradient_subset(train, k, seed, "idx")
    placed = with_ordinal(subset.select("idx"), [F.md5(F.concat(F.lit(f"{seed}:"), F.col("idx").cast("string"))), "idx"], "pos").checkpoint()
    rows, ids = placed.agg(F.count(F.lit(1)), F.sum(F.xxhash64("idx", "pos").cast("decimal(38,0)"))).first()
    meta = {"rows": rows, "width": len(coords), "dtype": "float32", "chunk_rows": chunk_rows, "coords": list(coords), "seed": seed,
            "tensors": [{"name": n, "size": s} for n, s in tensors], "value_bytes": rows * len(coords) * 4}
    plan = hashlib.sha256(json.dumps([str(ids), meta], sort_keys=True).encode()).hexdigest()
    chunks = -(-rows // chunk_rows)
    names = {info.base_name for info in where.get_file_info(_selector(folder))}
    missing = [i for i in range(chunks) if _chunk_name(plan, i) not in names]
    todo = placed.withColumn("chunk", F.floor(F.col("pos") / chunk_rows).cast("long"))
    if len(missing) < chunks:
        gone = spark.createDataFrame([(i,) for i in missing], "chunk long")
        todo = todo.join(gone, "chunk", "left_semi")
    rest = subset.join(todo, "idx")
    made = (grads(rest).select("idx", "grad", "loss").join(todo, "idx") if grads else rest).select(
        "chunk", F.col("pos").cast("long").alias("pos"), "idx", F.transform(gather(F.col("grad"), list(coords)), lambda x: x.cast("float")).alias("grad"),
        F.col("loss").cast("double").alias("loss"))
    (made.repartition(max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism)), "chunk").sortWithinPartitions("chunk", "pos")
     .write.format("gradient_store").mode("append").option("path", path).option("plan", plan).option("meta", json.dumps(meta)).save())
    return store_manifest(path)


def _selector(folder: str):
    from pyarrow import fs
    return fs.FileSelector(folder, allow_not_found=True)


def store_manifest(path: str) -> dict:
    """The manifest of a committed store."""
    where, folder = open_fs(path)
    if where.get_file_info(f"{folder}/{MANIFEST}").size is None:
        raise FileNotFoundError(f"{path} holds no committed gradient store")
    with where.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_gradient_store(spark: SparkSession, path: str, first: int = 0, rows: int | None = None) -> DataFrame:
    """(pos, idx, grad, loss) of the rows [first, first + rows) of a committed
    store; chunks without any of them are not opened."""
    m = store_manifest(path)
    end = m["rows"] if rows is None else min(m["rows"], first + rows)
    files = [f"{path.rstrip('/')}/{c['file']}" for c in m["chunks"] if c["first"] < end and c["first"] + c["rows"] > first]
    if not files:
        return spark.createDataFrame([], "pos long, idx long, grad array<float>, loss double")
    out = spark.read.parquet(*files)
    return out.where((F.col("pos") >= first) & (F.col("pos") < end))
