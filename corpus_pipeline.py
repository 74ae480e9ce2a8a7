"""The corpus pipeline: quality rules, quality classifier, near-duplicate
removal, repeated passages, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the next stage's documents, the last one the packed pieces. ``run``
writes each stage's result as Parquet in the shared folder and reads it again,
so a stage starts from files and a lost executor costs its own tasks only.

Every row has its own verdict, also where a doc_id is null or repeated: rows are
matched by a key of doc_id and text (and, for the rules, language), and of a
near-duplicate group one row stays. Extra columns are dropped; an empty table
passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.llm import common as C
from trainlens.llm import near_dedup, packing, quality_classifier, quality_rules, substring_dedup
from trainlens.session import ensure_checkpoint_dir, ship_package
from trainlens.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR_PERCENT = 80  # Jaccard similarity of five-word shingles; op3 alone has 85


def _keep(docs: DataFrame, kept: DataFrame, *key: Column | str) -> DataFrame:
    """The rows whose doc_id (nulls included) and row key of ``key`` are in
    ``kept`` (doc_id, rid)."""
    rows = kept.select(F.col("doc_id").alias("_kept"), F.col("rid").alias("_rid")).distinct()
    match = F.col("doc_id").eqNullSafe(F.col("_kept")) & (C.row_key(*key) == F.col("_rid"))
    return docs.select(*COLUMNS).join(rows, match, "left_semi")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return _keep(docs, quality_rules.judge(docs, read_table(spark, sf_dir, "labels")).where("kept"), "doc_id", "text", "lang")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return _keep(docs, quality_classifier.classify(docs, read_table(spark, sf_dir, "labels"), row_keys=True).where("kept"), "doc_id", "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id, then row key;
    of rows equal in both, the smallest (lang, source, n_chars), nulls first."""
    kept = near_dedup.survivors(docs, percent=NEAR_PERCENT).checkpoint()
    out = _keep(docs, kept, F.col("doc_id").cast("long"), "text")
    # equal rows share their key
    repeated = kept.where("copies > 1").limit(1).count()
    if not repeated:
        return out
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    least = F.min(F.struct(*rest)).alias("rest")
    return out.groupBy("doc_id", "text").agg(least).select("doc_id", "text", *[F.col(f"rest.{c}").alias(c) for c in rest])


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that start earlier in the corpus; a document
    that loses words keeps the rest, joined by single spaces, one that loses
    all of them goes, and one that loses none stays as it is."""
    cut = substring_dedup.dedup(docs, carry=("lang", "source", "n_chars"))
    return (cut.where("n_removed < n_words OR n_words = 0")
            .select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                    F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long")).alias("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces with their place in training sequences."""
    import public_tokenizers

    return packing.pack(packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: SQL can express neither exact binomial bounds over labelled holdouts, nor a
#: trained classifier, nor components, nor tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
