"""Record normalization and validation.

Violations are returned as DataFrames of (ordinal, sample_id, reason); only
functions named ``assert_*`` run an action and raise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlens.functions.text import is_blank, nonblank, strip
from trainlens.plans.ordinal import with_ordinal

# The fields that can carry training text, in the order they
# are tested.
TEXT_CANDIDATE_FIELDS = ("text", "prompt", "instruction", "input", "response", "output",
                         "completion", "target")


def dataset_prefix(name: str) -> str:
    p = name.strip().replace(" ", "-")
    return p or "dataset"


def coerce_to_strings(df: DataFrame) -> DataFrame:
    """Every column as a string, null -> ''."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def _opt(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def has_training_text(df: DataFrame):
    """Some candidate field holds non-blank text."""
    present = [F.col(c) for c in TEXT_CANDIDATE_FIELDS if c in df.columns]
    if not present:
        return F.lit(False)
    return F.greatest(*[F.coalesce(~is_blank(c), F.lit(False)) for c in present]) if len(present) > 1 \
        else F.coalesce(~is_blank(present[0]), F.lit(False))


def normalize_records(df: DataFrame, dataset_name: str, order_by: list[str],
                      keep: list[str] | None = None) -> DataFrame:
    """N01-N03 + N07: guarantee sample_id, source and license.

    ``order_by`` is the explicit row order (a total order) that the default
    id ``{prefix}-{ordinal:06d}`` numbers; the ordinal column ``ordinal`` is
    kept. Ids wider than six digits keep every digit. Whether a row has text
    is decided on the spot; the text fields themselves stay behind (numbering
    shuffles and writes its rows), unless ``keep`` names the columns to carry.
    Join texts back on ``order_by`` where they are needed.
    """
    prefix = dataset_prefix(dataset_name)
    if keep is None:
        keep = [c for c in df.columns if c not in TEXT_CANDIDATE_FIELDS]
    cols = list(dict.fromkeys([*order_by, *keep, *[c for c in ("sample_id", "source", "license") if c in df.columns]]))
    # range partitioning samples its input, so the narrow rows are written
    # first: the texts are read once
    narrow = df.withColumn("has_text", has_training_text(df)).select(*cols, "has_text").checkpoint()
    d = with_ordinal(narrow, [F.col(c) for c in order_by], name="ordinal")
    sid = nonblank(_opt(d, "sample_id").cast("string"))
    default_id = F.concat(F.lit(prefix + "-"), F.format_string("%06d", F.col("ordinal")))
    return (d.withColumn("sample_id", F.coalesce(sid, default_id))
             .withColumn("source", F.coalesce(nonblank(_opt(d, "source").cast("string")), F.lit(prefix)))
             .withColumn("license", F.coalesce(nonblank(_opt(d, "license").cast("string")),
                                               F.lit("unknown"))))


def record_violations(normalized: DataFrame) -> DataFrame:
    """Rows without training text, as (ordinal, sample_id, reason)."""
    return (normalized.where(~F.col("has_text"))
                      .select("ordinal", "sample_id",
                              F.lit("no non-empty text field").alias("reason")))


def duplicate_ids(df: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Blank ids and ids used more than once, as (sample_id, count, reason)."""
    blank = (df.where(is_blank(F.col(id_col)))
               .agg(F.count(F.lit(1)).alias("count"))
               .where(F.col("count") > 0)
               .select(F.lit("").alias("sample_id"), "count", F.lit("blank sample_id").alias("reason")))
    dup = (df.where(~is_blank(F.col(id_col)))
             .groupBy(strip(F.col(id_col)).alias("sample_id"))
             .agg(F.count(F.lit(1)).alias("count"))
             .where(F.col("count") > 1)
             .withColumn("reason", F.lit("duplicate sample_id")))
    return dup.unionByName(blank)


def assert_valid(normalized: DataFrame) -> None:
    """N05 + N06: raise on an empty dataset or on the first row without text."""
    if normalized.limit(1).count() == 0:
        raise ValueError("Dataset must contain at least one row")
    bad = record_violations(normalized).orderBy("ordinal").limit(1).collect()
    if bad:
        raise ValueError(f"Invalid dataset row at index {bad[0]['ordinal']}: "
                         "row has no non-empty text field")


def assert_unique_ids(df: DataFrame, id_col: str = "sample_id") -> None:
    bad = duplicate_ids(df, id_col).orderBy("sample_id").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['reason']}: {bad[0]['sample_id']!r}")
