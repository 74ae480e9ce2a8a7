"""Model-ready examples: manifest joins, templating, tokens, audits, fingerprints
(J01, J02, J04-J06, X01-X12)."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trainlens.functions.text import first_nonblank, nonblank, strip

# The prompt template and the attribution full-text layout.
PROMPT_HEAD = "### Instruction:\n"
PROMPT_TAIL = "\n\n### Response:\n"
INPUT_SEP = "\n\nInput:\n"


@dataclass(frozen=True)
class ExampleFields:
    prompt_field: str = "instruction"
    input_field: str | None = "input"
    response_field: str = "output"
    response_fallback_fields: tuple[str, ...] = ("response", "completion", "target")
    text_fields: tuple[str, ...] = ("text", "prompt", "instruction")


def _opt(df: DataFrame, c: str | None):
    return F.col(c).cast("string") if c and c in df.columns else F.lit(None).cast("string")


def build_examples(records: DataFrame, fields: ExampleFields = ExampleFields(),
                   with_response: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(sample_id, prompt, target, text[, response], error), and the
    columns ``carry`` of the records.

    prompt: the prompt field, else the first non-blank text field; a
    non-blank input is appended under "Input:". target: the response field,
    else the first non-blank fallback. Rows missing either carry an ``error``
    message (null otherwise) instead of raising.
    """
    prompt0 = first_nonblank(_opt(records, fields.prompt_field),
                             *[_opt(records, c) for c in fields.text_fields])
    inp = nonblank(_opt(records, fields.input_field))
    target = first_nonblank(_opt(records, fields.response_field),
                            *[_opt(records, c) for c in fields.response_fallback_fields])
    prompt = F.when(inp.isNotNull(), F.concat(prompt0, F.lit(INPUT_SEP), inp)).otherwise(prompt0)
    prompt_text = F.concat(F.lit(PROMPT_HEAD), prompt, F.lit(PROMPT_TAIL))
    tested = [fields.response_field, *fields.response_fallback_fields]
    err = (F.when(prompt0.isNull(),
                  F.concat(F.lit("Sample '"), F.col("sample_id"),
                           F.lit(f"' is missing prompt text (prompt_field='{fields.prompt_field}')")))
            .when(target.isNull(),
                  F.concat(F.lit("Sample '"), F.col("sample_id"),
                           F.lit(f"' is missing target answer (tested_fields={tested})"))))
    out = records.select("*", prompt_text.alias("prompt_text"), target.alias("target"), err.alias("error"))
    out = out.withColumn("text", F.concat("prompt_text", "target"))
    cols = ["sample_id", F.col("prompt_text").alias("prompt"), "target", "text", "error"]
    if with_response:
        cols.insert(4, F.col("target").alias("response"))
    return out.select(*cols, *carry)


def full_text(df: DataFrame) -> DataFrame:
    """Attribution text ``Instruction: ..\\nInput: ..\\nResponse: ..``."""
    inst = F.coalesce(strip(_opt(df, "instruction")), F.lit(""))
    inp = F.coalesce(strip(_opt(df, "input")), F.lit(""))
    out = F.coalesce(strip(_opt(df, "output")), F.lit(""))
    with_inp = F.concat(F.lit("Instruction: "), inst, F.lit("\nInput: "), inp, F.lit("\nResponse: "), out)
    without = F.concat(F.lit("Instruction: "), inst, F.lit("\nResponse: "), out)
    return df.withColumn("full_text", F.when(F.length(inp) > 0, with_inp).otherwise(without))


def join_manifest(manifest: DataFrame, records: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Manifest rows joined to their records, manifest order (``pos``) kept."""
    return manifest.join(records, id_col, "inner")


def unknown_ids(manifest: DataFrame, records: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Manifest ids with no record."""
    return manifest.select(id_col).join(records.select(id_col), id_col, "left_anti")


def assert_known_ids(manifest: DataFrame, records: DataFrame, split_name: str,
                     id_col: str = "sample_id") -> None:
    unknown = unknown_ids(manifest, records, id_col).orderBy(id_col).limit(11).toPandas()[id_col]
    if len(unknown):
        # fixed value: the start of this message
        raise ValueError(f"{split_name} split contains sample_ids not present in original dataset: "
                         + ", ".join(unknown[:10].astype(str)) + " and more" * (len(unknown) > 10))


# Manifest columns that carry a corpus index, tried in order.
INDEX_COLUMNS = ("alpaca_idx", "json_idx", "row_id", "index", "idx")


def resolve_manifest(manifest: DataFrame, corpus: DataFrame, idx_col: str = "idx") -> DataFrame:
    """J04 + J05: map manifest rows to corpus indices.

    (a) the first index-named column; else (b) trailing digits of sample_id
    when every row has them; else (c) exact (instruction, input, output)
    match, the last corpus row winning duplicates. Adds ``resolved_idx``
    (null when unresolved) and the corpus columns via a left join.
    """
    present = [c for c in INDEX_COLUMNS if c in manifest.columns]
    if present:
        m = manifest.withColumn("resolved_idx", F.col(present[0]).try_cast("long"))
    else:
        parsed = F.nullif(F.regexp_extract(F.col("sample_id").cast("string"), r"(\d+)$", 1), F.lit(""))
        m = manifest.withColumn("_parsed", parsed.try_cast("long"))
        all_parse = m.agg(F.count(F.lit(1)).alias("n"), F.count("_parsed").alias("p")).first()
        if all_parse["n"] == all_parse["p"]:
            m = m.withColumn("resolved_idx", F.col("_parsed")).drop("_parsed")
        elif all(c in manifest.columns for c in ("instruction", "output")):
            key = [F.coalesce(strip(_opt(corpus, c)), F.lit("")).alias(f"_t{i}")
                   for i, c in enumerate(("instruction", "input", "output"))]
            last = corpus.select(*key, F.col(idx_col)).groupBy("_t0", "_t1", "_t2") \
                         .agg(F.max(idx_col).alias("resolved_idx"))
            mk = [F.coalesce(strip(_opt(m, c)), F.lit("")).alias(f"_t{i}")
                  for i, c in enumerate(("instruction", "input", "output"))]
            m = m.drop("_parsed").select("*", *mk).join(last, ["_t0", "_t1", "_t2"], "left") \
                 .drop("_t0", "_t1", "_t2")
        else:
            m = m.drop("_parsed").withColumn("resolved_idx", F.lit(None).cast("long"))
    src = corpus.select(*[F.col(c).alias(c if c != idx_col else "resolved_idx")
                          for c in corpus.columns if c not in m.columns or c == idx_col])
    return m.join(src, "resolved_idx", "left")


def unresolved_rows(resolved: DataFrame, required: list[str]) -> DataFrame:
    """J04 + J05: rows of ``resolve_manifest`` without a corpus index, or whose
    index has no corpus row (a ``required`` corpus column is null)."""
    no_row = F.lit(False)
    for c in required:
        no_row = no_row | F.col(c).isNull()
    reason = F.when(F.col("resolved_idx").isNull(), "no corpus index").when(no_row, "no corpus row")
    return resolved.withColumn("reason", reason).where("reason IS NOT NULL").select("sample_id", "resolved_idx", "reason")


def assert_resolved(resolved: DataFrame, required: list[str]) -> None:
    bad = unresolved_rows(resolved, required).orderBy("sample_id").limit(1).collect()
    if bad:
        raise ValueError(f"manifest row {bad[0]['sample_id']!r} could not be resolved: {bad[0]['reason']}")


def subset_positions(subset: DataFrame, train: DataFrame, id_col: str = "sample_id",
                     pos_col: str = "pos") -> DataFrame:
    """Gradient-subset ids mapped to their train position; ids not in
    train come back with a null position."""
    return subset.select(id_col).join(train.select(id_col, pos_col), id_col, "left")


# ---------------------------------------------------------------- tokens
def hashed_token_ids(text_col, max_len: int, vocab: int = 32000):
    """X07 (built-in tokenizer): whitespace tokens, truncated to max_len, each
    id = first 32 bits of md5(token) mod vocab (portable to any SQL engine)."""
    toks = F.filter(F.split(F.col(text_col) if isinstance(text_col, str) else text_col, r"\s+"),
                    lambda t: t != "")
    toks = F.slice(toks, 1, max_len)
    return F.transform(toks, lambda t: F.pmod(
        F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(vocab)).cast("int"))


def tokenize(examples: DataFrame, max_len: int, padding: str = "longest", vocab: int = 32000,
             text_col: str = "text") -> DataFrame:
    """X07 + X08: input_ids and attention_mask per row.

    ``longest`` pads nothing (each row is encoded alone); ``max_length`` pads
    ids with 0 up to max_len and sets the mask to 0 on padding.
    """
    d = examples.withColumn("input_ids", hashed_token_ids(text_col, max_len, vocab))
    d = d.withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1)))
    if padding == "max_length":
        pad = F.greatest(F.lit(max_len) - F.size("input_ids"), F.lit(0))
        d = (d.withColumn("attention_mask", F.concat("attention_mask", F.array_repeat(F.lit(0), pad)))
              .withColumn("input_ids", F.concat("input_ids", F.array_repeat(F.lit(0), pad))))
    elif padding not in ("longest", "do_not_pad"):
        raise ValueError(f"unsupported padding {padding!r}")
    return d


def tokenize_with(examples: DataFrame, encode, max_len: int, text_col: str = "text") -> DataFrame:
    """X07 hook: a user tokenizer ``encode(list[str], max_len) -> list[list[int]]``
    applied batch-wise with mapInPandas (Arrow batches, one call per batch)."""
    import pandas as pd

    from pyspark.sql import types as T
    schema = (T.StructType(list(examples.schema.fields))
              .add("input_ids", T.ArrayType(T.IntegerType()))
              .add("attention_mask", T.ArrayType(T.IntegerType())))

    def run(batches):
        for pdf in batches:
            ids = encode(pdf[text_col].fillna("").tolist(), max_len)
            pdf = pdf.copy()
            pdf["input_ids"] = pd.Series([list(map(int, x)) for x in ids], index=pdf.index)
            pdf["attention_mask"] = pd.Series([[1] * len(x) for x in ids], index=pdf.index)
            yield pdf
    return examples.mapInPandas(run, schema)


def tensor_violations(tok: DataFrame, padding: str, max_len: int, id_col: str = "sample_id") -> DataFrame:
    """(sample_id, reason) for empty, unequal or wrongly padded rows."""
    ids, mask = F.size("input_ids"), F.size("attention_mask")
    reasons = [
        (F.col("input_ids").isNull() | F.col("attention_mask").isNull(), "missing tensor field"),
        (ids == 0, "input_ids is empty"),
        (ids != mask, "input_ids and attention_mask lengths differ"),
    ]
    if padding == "max_length":
        reasons.append((ids != max_len, f"length differs from max_length={max_len}"))
    else:
        reasons.append((ids > max_len, f"length exceeds max_seq_len={max_len}"))
    arr = F.array(*[F.when(c, F.lit(r)) for c, r in reasons])
    return (tok.select(id_col, F.filter(arr, lambda x: x.isNotNull()).alias("r"))
               .select(id_col, F.explode("r").alias("reason")))


def label_schema_violations(df: DataFrame, collator_path: str) -> list[str]:
    """The LM path must not carry ``labels``; the padding path needs them."""
    has = "labels" in df.columns
    if collator_path == "lm_generate_labels" and has:
        return ["labels column present but the collator generates labels"]
    if collator_path == "padding_requires_labels" and not has:
        return ["labels column required by the padding collator"]
    return []


def null_label_violations(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Rows of a labelled table whose ``labels`` are null."""
    return df.where(F.col("labels").isNull()).select(id_col, F.lit("labels is null").alias("reason"))


def dataset_fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """X11: order-independent fingerprint of a table: row count, and the xor
    and the sum (modulo 2**61) of a 60-bit md5 prefix of every row. The sum
    tells tables apart whose equal rows cancel in the xor. Fields are written
    as ``n`` for null or ``v``, their length and their text, so neither nulls
    nor separators inside a text can be mistaken. One pass with partial
    aggregation; any SQL engine with md5 reproduces it."""
    cols = cols or df.columns
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *_fingerprint(cols))


def _fingerprint(cols: list[str]) -> list:
    """The aggregates ``xor_hash`` and ``sum_hash`` over rows of ``cols``."""
    text = lambda c: F.col(c).cast("string")
    row = F.concat(*[F.when(F.col(c).isNull(), F.lit("n")).otherwise(
        F.concat(F.lit("v"), F.octet_length(text(c)).cast("string"), F.lit(":"), text(c))) for c in cols])
    h = F.conv(F.substring(F.md5(row), 1, 15), 16, 10).cast("long")
    total = (F.sum(h.cast("decimal(20,0)")) % F.lit(1 << 61).cast("decimal(20,0)")).cast("long")
    return [F.bit_xor(h).alias("xor_hash"), F.coalesce(total, F.lit(0).cast("long")).alias("sum_hash")]


def settings_key(**settings) -> str:
    """X11: cache key of the settings (canonical JSON, sha256)."""
    payload = json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(payload.encode("utf-8")).hexdigest()


@dataclass
class CacheKey:
    dataset: str
    tokenizer: str
    max_len: int
    padding: str
    fields: dict = field(default_factory=dict)
    splits: str = ""

    def digest(self) -> str:
        return settings_key(**asdict(self))


def cached(spark, path_root: str, key: str, build) -> DataFrame:
    """Read the Parquet table stored under the key, else build and write it."""
    import os
    path = os.path.join(path_root, key)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")):  # noqa: SLF001
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ---- X11 + X12: a digest tree over key buckets, and a cache rebuilt by bucket
BUCKETS = 64


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def bucket_digests(df: DataFrame, key: str, *, buckets: int = BUCKETS, cols: list[str] | None = None) -> DataFrame:
    """X11: (bucket, n_rows, digest) over the rows whose key hashes there; the
    digest is that of ``dataset_fingerprint`` and doesn't depend on row order."""
    cols = cols or df.columns
    keyed = df.withColumn("_bucket", _bucket(key, buckets))
    return (keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n_rows"), *_fingerprint(cols))
            .select(F.col("_bucket").alias("bucket"), "n_rows",
                    F.sha2(F.concat_ws(":", "n_rows", "xor_hash", "sum_hash"), 256).alias("digest")))


def digest_tree(digests: DataFrame, *, buckets: int = BUCKETS, fan: int = 8) -> DataFrame:
    """X11: (level, node, digest) of the tree over the buckets, an empty bucket
    counting as the empty string; the root is the node of the highest level.
    There are ``buckets`` leaves however large the table is."""
    rows = {r["bucket"]: r["digest"] for r in digests.collect()}
    level, out, depth = [rows.get(i, "") for i in range(buckets)], [], 0
    while True:
        out += [(depth, i, d) for i, d in enumerate(level)]
        if len(level) == 1:
            return digests.sparkSession.createDataFrame(out, "level int, node int, digest string")
        level = [hashlib.sha256("".join(level[i:i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
        depth += 1


def _versions(spark, path: str) -> list[int]:
    """Numbers of the published manifests, oldest first."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest-*/_SUCCESS"))  # noqa: SLF001
    return sorted(int(str(f.getPath().getParent().getName()).split("-")[1]) for f in done or [])


def cached_by_bucket(df: DataFrame, path: str, key: str, build, *, buckets: int = BUCKETS, settings: str = "") -> DataFrame:
    """``build(df)`` from a stored copy of which only the buckets of changed
    records are made anew.

    ``build`` makes rows that carry ``key`` from records of the same key alone.
    The table is stored by bucket; a manifest (bucket, digest of its records,
    folder) is written last, as a new number, and readers take the newest one
    that is complete. So a refresh shows as a whole or not at all, and readers
    of the old manifest keep their files. Other ``settings`` rebuild everything.
    Rows of ``df`` must not change while this runs.
    """
    spark = df.sparkSession
    now = {r["bucket"]: r["digest"] for r in bucket_digests(df, key, buckets=buckets).collect()}
    known = _versions(spark, path)
    same: list = []
    if known:
        m = spark.read.parquet(f"{path}/manifest-{known[-1]:06d}").where((F.col("settings") == settings) & (F.col("buckets") == buckets))
        same = m.collect()
    old = {r["bucket"]: (r["digest"], r["folder"]) for r in same if r["bucket"] is not None}
    changed = [b for b in now if old.get(b, ("",))[0] != now[b]]
    number = known[-1] + 1 if known else 0
    if changed or set(now) != set(old) or not same:
        folder = f"data-{number:06d}-{uuid.uuid4().hex[:8]}"
        some = df.where(_bucket(key, buckets).isin(changed)) if changed else df.limit(0)
        made = build(some).withColumn("_bucket", _bucket(key, buckets))
        made.write.partitionBy("_bucket").parquet(f"{path}/{folder}")
        shape = build(df.limit(0)).schema.json()
        rows = [(b, now[b], folder if b in changed else old[b][1], settings, buckets, shape) for b in now] or [(None, None, None, settings, buckets, shape)]
        (spark.createDataFrame(rows, "bucket int, digest string, folder string, settings string, buckets int, shape string")
         .coalesce(1).write.parquet(f"{path}/manifest-{number:06d}"))
    return read_by_bucket(spark, path)


def read_by_bucket(spark, path: str) -> DataFrame:
    """The table of the newest complete manifest."""
    known = _versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no complete manifest under {path}")
    rows = spark.read.parquet(f"{path}/manifest-{known[-1]:06d}").collect()  # one row per bucket
    shape = T.StructType.fromJson(json.loads(rows[0]["shape"]))
    jvm = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    fs = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    places = [f"{path}/{r['folder']}/_bucket={r['bucket']}" for r in rows if r["bucket"] is not None]
    places = [p for p in places if fs.exists(jvm.Path(p))]  # a bucket may have built no rows
    return spark.read.schema(shape).parquet(*places) if places else spark.createDataFrame([], shape)
