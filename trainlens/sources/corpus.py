"""Domain views over the driver tables.

The attribution workflow needs a corpus of records, instruction examples,
train/test/shadow membership, lexical probes, a vector bank and per-sample
gradients. These functions derive each from the given tables with Spark, so
every downstream query grows with the input:

* corpus record   -- ``documents``: sample_id = doc_id, source, license = lang
* instructions    -- ``conversations``: a user turn paired with the next
                     assistant turn; the conversation's system text is input
* vector samples  -- ``embeddings`` (unit-norm 64-d) with a hashed split
* gradients       -- closed-form logistic-probe gradients of the embeddings
* lexical probes  -- ``benchmark`` items
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trainlens.functions.hashing import hash_bucket
from trainlens.functions.vector import dot, repeated, sigmoid
from trainlens.sources.tables import read_table

SPLIT_SEED = 2026
SPLIT_BUCKETS = 10


def split_of(id_col, seed: int = SPLIT_SEED):
    """Hashed membership: bucket 0 -> test, 1 -> shadow, every other -> train."""
    b = hash_bucket(seed, id_col, SPLIT_BUCKETS)
    return F.when(b == 0, "test").when(b == 1, "shadow").otherwise("train")


def split_sql(id_expr: str, seed: int = SPLIT_SEED) -> str:
    """The same membership rule in ANSI SQL (DuckDB dialect)."""
    h = f"(('0x' || substr(md5('{seed}:' || CAST({id_expr} AS VARCHAR)), 1, 8))::BIGINT % {SPLIT_BUCKETS})"
    return f"(CASE {h} WHEN 0 THEN 'test' WHEN 1 THEN 'shadow' ELSE 'train' END)"


# The logistic probe used for closed-form gradients. The weight
# of coordinate i is (((7 * i) mod 13) - 6) / 8, so every weight is an exact
# binary fraction; there are as many as the vector is wide.
def probe_weights(vec):
    cycle = F.array(*[F.lit(((7 * i) % 13 - 6) / 8.0) for i in range(13)])
    size = F.size(vec)
    return F.slice(F.flatten(F.array_repeat(cycle, F.floor(size / 13).cast("int") + 1)), F.lit(1), F.greatest(size, F.lit(0)))


def probe_weights_sql(vec: str) -> str:
    return f"list_transform(range(len({vec})), lambda i: ((i * 7) % 13 - 6) / 8.0::DOUBLE)"


def instruction_records(spark: SparkSession, sf_dir: str, answered: bool = True) -> DataFrame:
    """(conv_id, turn, instruction, input, output) from conversation turns.

    A user turn is paired with the turn that follows it when that turn is an
    assistant turn. The conversation's system text (first system turn) is the
    input. Windows partition by conversation, so they never gather the table.
    With ``answered=False`` user turns without an answer stay, output null.
    """
    c = read_table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = (c.withColumn("next_role", F.lead("role").over(w))
            .withColumn("next_text", F.lead("text").over(w)))
    system = (c.where(F.col("role") == "system")
               .groupBy("conv_id")
               .agg(F.min_by("text", "turn").alias("input")))
    reply = F.col("next_role") == "assistant"
    pairs = nxt.where(F.col("role") == "user").withColumn("next_text", F.when(reply, F.col("next_text")))
    pairs = pairs.where(reply) if answered else pairs
    return (pairs.join(system, "conv_id", "left")
                 .select("conv_id", "turn", F.col("text").alias("instruction"),
                         F.coalesce("input", F.lit("")).alias("input"),
                         F.col("next_text").alias("output")))


def vector_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, split, label, y, vec, grad, loss) for every embedding row.

    The gradient is that of a fixed logistic probe on the embedding with
    target y = (label < 5): g = (sigmoid(w . x) - y) * x, loss = binary
    cross-entropy. Norms vary across rows, so dot-product influence differs
    from cosine.
    """
    e = read_table(spark, sf_dir, "embeddings")
    w = probe_weights(F.col("vec"))
    vec = F.transform("embedding", lambda x: x.cast("double"))
    y = (F.col("label") < 5).cast("double")
    z = dot(w, "vec")
    p = sigmoid(z)
    return (e.select(F.col("vec_id").alias("idx"), "label", vec.alias("vec"))
             .withColumn("y", y)
             .withColumn("_p", p)
             .withColumn("grad", F.zip_with("vec", repeated(F.col("_p") - F.col("y"), "vec"), lambda x, c: c * x))
             .withColumn("loss", -(F.col("y") * F.log(F.col("_p"))
                                   + (1 - F.col("y")) * F.log(1 - F.col("_p"))))
             .withColumn("split", split_of(F.col("idx")))
             .drop("_p"))


def vector_samples_sql() -> str:
    """DuckDB form of :func:`vector_samples` (a CTE body)."""
    w = probe_weights_sql("embedding")
    return f"""
    SELECT idx, label, vec, y, split,
           list_transform(vec, lambda x: (p - y) * x) AS grad,
           -(y * ln(p) + (1 - y) * ln(1 - p)) AS loss
    FROM (
      SELECT vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS vec,
             CAST(label < 5 AS DOUBLE) AS y,
             1.0 / (1.0 + exp(-list_dot_product({w}, CAST(embedding AS DOUBLE[])))) AS p,
             {split_sql('vec_id')} AS split
      FROM embeddings
    )"""


def text_probes(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    """Every document of a split as a probe (idx, text, source, vec, grad, loss).
    One without a vector sample keeps nulls there: text methods rank it, its
    similarity and influence are 0, and gradient cosine has no list for it."""
    docs = (read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text", "source")
            .withColumn("split", split_of(F.col("idx"))).where(F.col("split") == split))
    return docs.join(vector_samples(spark, sf_dir).drop("split"), "idx", "left")


def text_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole train side: every train document and every train vector sample
    (idx, text, source, vec, grad). A text without a vector keeps nulls there,
    and so does a vector without a text; each method says what that scores."""
    docs = (read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text", "source", F.lit(True).alias("has_text"))
            .where(split_of(F.col("idx")) == "train"))
    vecs = vector_samples(spark, sf_dir).where(F.col("split") == "train").drop("split")
    return docs.join(vecs, "idx", "full").withColumn("has_text", F.coalesce("has_text", F.lit(False)))


def _split_texts(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """(idx, text) of a split's documents, as often as their join with the vector
    samples gives them. Only a repeated sample id can change that, so ids are
    counted first and texts are joined, and so shuffled, only where one repeats."""
    docs = (read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")
            .where(split_of(F.col("idx")) == split))
    repeated = (read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx")).where("idx IS NOT NULL")
                .groupBy("idx").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    if repeated.isEmpty():
        return docs
    return (docs.join(repeated, "idx", "left")
            .select("idx", "text", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))).alias("_copy")).drop("_copy"))


def probe_texts(spark: SparkSession, sf_dir: str, split: str = "test") -> DataFrame:
    """The ids and texts of :func:`text_probes`, without the join with vectors."""
    return _split_texts(spark, sf_dir, split)


def bank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids and texts of the documents of :func:`text_bank`, likewise."""
    return _split_texts(spark, sf_dir, "train")


def lexical_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("probe_id"), "text")
