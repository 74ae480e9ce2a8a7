"""SQL building blocks for oracle statements (DuckDB dialect).

These restate the domain views and operators as plain SQL so that the Spark
plans can be checked against an independent engine.
"""

from __future__ import annotations

from trainlens.operators.lexical import Bm25Params
from trainlens.sources.corpus import split_sql, vector_samples_sql

TOKENS = "list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> '')"


def tokens(c: str) -> str:
    return TOKENS.format(c=c)


def samples_ctes() -> str:
    """CTEs: s (vector samples), ts (every document with its sample, if any)."""
    return f"""s AS ({vector_samples_sql()}),
    ts AS (SELECT d.doc_id AS idx, s.label, s.vec, s.y, {split_sql('d.doc_id')} AS split, s.grad, s.loss, d.text, d.source
           FROM documents d LEFT JOIN s ON s.idx = d.doc_id)"""


def idf_ctes(docs: str, p: Bm25Params = Bm25Params()) -> str:
    """CTEs ``dfs`` and ``idf`` over ``docs`` (bank_id, text), and what they need."""
    return f"""toks AS (SELECT bank_id, {tokens('text')} AS toks FROM {docs}),
    dl AS (SELECT bank_id, CAST(len(toks) AS DOUBLE) AS dl FROM toks),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    post AS (SELECT bank_id, term, count(*) AS tf
             FROM (SELECT bank_id, unnest(toks) AS term FROM toks) GROUP BY bank_id, term),
    dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    raw AS (SELECT term, ln((SELECT n FROM stats) - df + 0.5) - ln(df + 0.5) AS raw_idf FROM dfs),
    idf AS (SELECT term, CASE WHEN raw_idf < 0
                 THEN {p.epsilon} * (SELECT avg(raw_idf) FROM raw) ELSE raw_idf END AS idf
             FROM raw)"""


def bm25_ctes(probes: str, docs: str, k: int, p: Bm25Params = Bm25Params()) -> str:
    """CTEs ending in ``bm25`` (probe_id, bank_id, score, rank <= k).

    ``probes`` is a CTE with (probe_id, text); ``docs`` with (bank_id, text).
    Documents sharing no term with a probe score 0 and rank by lowest id.
    """
    return f"""{idf_ctes(docs, p)},
    w AS (SELECT post.bank_id, term,
                tf * {p.k1 + 1} / (tf + {p.k1} * ({1 - p.b} + {p.b} * dl / (SELECT avgdl FROM stats))) AS weight
             FROM post JOIN dl ON dl.bank_id = post.bank_id),
    qt AS (SELECT probe_id, term, count(*) AS qtf
            FROM (SELECT probe_id, unnest({tokens('text')}) AS term FROM {probes}) GROUP BY probe_id, term),
    pw AS (SELECT probe_id, qt.term, qtf * idf AS weight FROM qt JOIN idf ON idf.term = qt.term),
    sc AS (SELECT probe_id, bank_id, sum(pw.weight * w.weight) AS score
            FROM pw JOIN w ON w.term = pw.term GROUP BY probe_id, bank_id),
    allp AS (SELECT p.probe_id, d.bank_id, coalesce(sc.score, 0.0) AS score
              FROM (SELECT DISTINCT probe_id FROM {probes}) p CROSS JOIN (SELECT bank_id FROM {docs}) d
              LEFT JOIN sc sc ON sc.probe_id = p.probe_id AND sc.bank_id = d.bank_id),
    bm25 AS (SELECT * FROM (
              SELECT probe_id, bank_id, score,
                     row_number() OVER (PARTITION BY probe_id ORDER BY round(score, 9) DESC, bank_id) AS rank
              FROM allp) WHERE rank <= {k})"""


def cosine(a: str, b: str) -> str:
    """Cosine with each norm clipped at 1e-12."""
    return (f"(list_dot_product({a}, {b}) / (greatest(sqrt(list_dot_product({a}, {a})), 1e-12)"
            f" * greatest(sqrt(list_dot_product({b}, {b})), 1e-12)))")


def minmax(col: str, part: str) -> str:
    lo, hi = f"min({col}) OVER (PARTITION BY {part})", f"max({col}) OVER (PARTITION BY {part})"
    return (f"(CASE WHEN abs({hi} - {lo}) <= 1e-8 + 1e-5 * abs({lo}) THEN 0.0 "
            f"ELSE ({col} - {lo}) / ({hi} - {lo}) END)")


TOP_K = 5
SHORTLIST = 30
ALPHA = 0.5


def sample_bm25(split: str = "test") -> str:
    """WITH-body: samples, probes of a split vs train docs, BM25 shortlist ``bm25``."""
    return f"""{samples_ctes()},
probes AS (SELECT idx AS probe_id, text FROM ts WHERE split = '{split}'),
docs AS (SELECT doc_id AS bank_id, text FROM documents WHERE {split_sql('doc_id')} = 'train'),
{bm25_ctes('probes', 'docs', SHORTLIST)}"""


def hybrid_ctes() -> str:
    """CTEs ``sem``, ``nrm``, ``hyb``, ``rk`` (hybrid order over the shortlist)."""
    return f"""sem AS (SELECT b.probe_id, b.bank_id, b.score AS bm25_score,
               coalesce({cosine('p.vec', 'd.vec')}, 0.0) AS semantic_score
        FROM bm25 b LEFT JOIN s p ON p.idx = b.probe_id LEFT JOIN s d ON d.idx = b.bank_id),
nrm AS (SELECT *, {minmax('bm25_score', 'probe_id')} AS bm25_norm,
               {minmax('semantic_score', 'probe_id')} AS semantic_norm FROM sem),
hyb AS (SELECT *, {ALPHA} * bm25_norm + {1 - ALPHA} * semantic_norm AS hybrid_score FROM nrm),
rk AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(hybrid_score, 9) DESC, bank_id) AS rank
       FROM hyb)"""


def influence_ctes() -> str:
    """CTEs ``inf``, ``irk``: gradient dot on the shortlist, ranked."""
    return """inf AS (SELECT b.probe_id, b.bank_id, coalesce(list_dot_product(p.grad, d.grad), 0.0) AS score
        FROM bm25 b LEFT JOIN s p ON p.idx = b.probe_id LEFT JOIN s d ON d.idx = b.bank_id),
irk AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(score, 9) DESC, bank_id) AS rank
        FROM inf)"""


def cosine_ctes(probe_split: str = "test", src: str = "ts") -> str:
    """CTEs ``cs``, ``crk``: gradient cosine of the probes of view ``src``
    (``ts``: samples with text, ``s``: every vector sample) against every train
    sample."""
    return f"""cs AS (SELECT p.idx AS probe_id, b.idx AS bank_id, {cosine('p.grad', 'b.grad')} AS score
       FROM (SELECT idx, grad FROM {src} WHERE split = '{probe_split}' AND grad IS NOT NULL) p
       CROSS JOIN (SELECT idx, grad FROM s WHERE split = 'train') b),
crk AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY round(score, 9) DESC, bank_id) AS rank
        FROM cs)"""


def merged_ctes(split: str = "test") -> str:
    """WITH-body ending in ``merged`` (test_idx, method, rank, train_idx, score)."""
    return f"""{sample_bm25(split)},
{hybrid_ctes()},
{influence_ctes()},
{cosine_ctes(split)},
merged AS (
  SELECT probe_id AS test_idx, 'hybrid' AS method, CAST(rank AS INTEGER) AS rank,
         bank_id AS train_idx, hybrid_score AS score FROM rk WHERE rank <= {TOP_K}
  UNION ALL
  SELECT probe_id, 'gradient_cosine', CAST(rank AS INTEGER), bank_id, score FROM crk WHERE rank <= {TOP_K}
  UNION ALL
  SELECT probe_id, 'influence', CAST(rank AS INTEGER), bank_id, score FROM irk WHERE rank <= {TOP_K})"""
