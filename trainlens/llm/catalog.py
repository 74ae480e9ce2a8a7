"""Registered queries of the training-data operators."""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.llm import (
    fill_in_middle,
    knn_join,
    near_dedup,
    packing,
    phrase_mining,
    quality_classifier,
    quality_rules,
    sentencepiece_scan,
    substring_dedup,
    suffix_dedup,
    toxicity,
    url_filters,
    warc,
)
from trainlens.registry import ORACLES, QUERIES
from trainlens.sources.tables import read_table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document once repeated passages are removed."""
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents"), with_text=False)


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every document once repeated strings are removed."""
    return suffix_dedup.dedup(read_table(spark, sf_dir, "documents"), with_bytes=False)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 1,024 tokens."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after a round trip through archives."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, and whether they decode to
    its text."""
    import public_tokenizers

    return sentencepiece_scan.encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and risk-controlled verdict of every document."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and verdict of every document."""
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every twentieth vector."""
    v = knn_join.clean(read_table(spark, sf_dir, "embeddings"))
    return knn_join.topk(v, v.where("vec_id % 20 = 0"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page."""
    return url_filters.classify(read_table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, url_filters.RULES))


def op11_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of every language."""
    return phrase_mining.mine(read_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and checksums of every document's transformed and restored text."""
    cut = fill_in_middle.transform(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_in_middle.restore("output", "form"), 256).alias("restored_sha256"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, with the number of its offending sentences."""
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS most FROM pages),
h AS (SELECT page_id, most, body, sha1(body) AS hex FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(
         (CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM most THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM most THEN most END AS refers_to
FROM h
"""

OP9_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, url,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
s AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
j AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM s)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, unnest(w) AS phrase, 1 AS size FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w WHERE len(w) > 2),
f AS (SELECT lang, phrase, size, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
k AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE size = 3),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, l.a AS l, r.a AS r, (1000000::HUGEINT * k.a * k.a) // (l.a::HUGEINT * r.a) AS score
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = k.x JOIN f r ON r.lang = k.lang AND r.phrase = k.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE size = 3)
  GROUP BY ALL),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < 50 * a)
SELECT o.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
       CAST(score AS BIGINT) AS score
FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                      ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS out FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(out) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN out
         WHEN 'psm' THEN split_part(substr(out, 4), '<S>', 1) || split_part(out, '<M>', 2) || split_part(split_part(out, '<S>', 2), '<M>', 1)
         ELSE split_part(split_part(out, '<P>', 2), '<M>', 1) || split_part(out, '<M>', 2) || split_part(substr(out, 4), '<P>', 1) END) AS restored_sha256
FROM o
"""

_QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_suffix_array_dedup": op2_suffix_array_dedup,
            "op3_minhash_near_dedup": op3_minhash_near_dedup,
            "op4_best_fit_packing": op4_best_fit_packing,
            "op5_warc": op5_warc, "op6_sentencepiece": op6_sentencepiece,
            "op7_quality_rules": op7_quality_rules, "op8_quality_classifier": op8_quality_classifier,
            "op9_exact_topk": op9_exact_topk, "op10_url_filters": op10_url_filters,
            "op11_phrase_collocation": op11_phrase_collocation, "op12_fill_in_middle": op12_fill_in_middle, "op13_toxicity": op13_toxicity}
_ORACLES = {"op5_warc": OP5_SQL, "op9_exact_topk": OP9_SQL, "op10_url_filters": OP10_SQL,
            "op11_phrase_collocation": OP11_SQL,
            "op12_fill_in_middle": OP12_SQL}


def load(pipeline: ModuleType) -> None:
    """Add these queries and the pipeline to the registry."""
    QUERIES.update(_QUERIES)
    QUERIES["pipeline"] = pipeline.run
    ORACLES.update(_ORACLES)
    if pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = pipeline.ORACLE_SQL
