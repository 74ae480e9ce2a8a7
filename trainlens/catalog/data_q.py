"""Registered data-foundation queries: normalize (N*), split (C*), examples and
tokens (X*, J01), lengths (T*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainlens.catalog.attribution_q import r6
from trainlens.operators import examples as X
from trainlens.operators import lengths as L
from trainlens.operators import normalize as N
from trainlens.operators import splits as C
from trainlens.registry import register
from trainlens.sources.corpus import instruction_records, vector_samples, vector_samples_sql
from trainlens.sources.tables import read_table

STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _strip(c: str) -> str:
    return STRIP.format(c=c)


def normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return N.normalize_records(docs, "documents", ["doc_id"])


_NORM_SQL = f"""WITH nd AS (
  SELECT doc_id, text, lang,
         row_number() OVER (ORDER BY doc_id) - 1 AS ordinal,
         coalesce(nullif({_strip('source')}, ''), 'documents') AS source
  FROM documents),
n AS (SELECT *, 'documents-' || printf('%06d', ordinal) AS sample_id, 'unknown' AS license,
             coalesce(length({_strip('text')}) > 0, false) AS has_text FROM nd)"""


@register("normalized_documents", _NORM_SQL + """
SELECT sample_id, doc_id, source, license, lang, CAST(ordinal AS BIGINT) AS ordinal, has_text FROM n""")
def q_normalized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default ids from the doc_id order, default source/license,
    text presence."""
    n = normalized_documents(spark, sf_dir)
    return n.select("sample_id", "doc_id", "source", "license", "lang", "ordinal", "has_text")


@register("record_violations", f"""
WITH sy AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS text FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS ordinal,
             coalesce(length({_strip('text')}) > 0, false) AS has_text FROM sy)
SELECT CAST(ordinal AS BIGINT) AS ordinal, 'system-prompts-' || printf('%06d', ordinal) AS sample_id,
       'no non-empty text field' AS reason FROM n WHERE NOT has_text""")
def q_record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records without any training text, by ordinal; the records are the
    conversations' system texts, which many conversations lack."""
    c = read_table(spark, sf_dir, "conversations")
    system = F.min_by(F.when(F.col("role") == "system", F.col("text")),
                      F.when(F.col("role") == "system", F.col("turn")))
    return N.record_violations(N.normalize_records(c.groupBy("conv_id").agg(system.alias("text")), "system prompts", ["conv_id"]))


@register("instruction_id_audit", """
WITH p AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role
           FROM conversations),
r AS (SELECT CAST(conv_id AS VARCHAR) AS sample_id FROM p WHERE role = 'user' AND next_role = 'assistant')
SELECT sample_id, count(*) AS count, 'duplicate sample_id' AS reason FROM r GROUP BY sample_id HAVING count(*) > 1
""")
def q_instruction_id_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed by conversation, instruction pairs repeat ids (one per user turn)."""
    recs = instruction_records(spark, sf_dir).withColumn("sample_id", F.col("conv_id").cast("string"))
    return N.duplicate_ids(recs)


STRATA = ("source", "lang")


@register("split_allocation", """
WITH st AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang),
f AS (SELECT *, floor(n * 0.8) AS f_tr, floor(n * 0.1) AS f_te, floor(n * 0.1) AS f_sh,
             n * 0.8 - floor(n * 0.8) AS x_tr, n * 0.1 - floor(n * 0.1) AS x_te, n * 0.1 - floor(n * 0.1) AS x_sh
      FROM st),
r AS (SELECT *, n - f_tr - f_te - f_sh AS rem,
        (CASE WHEN x_te > x_tr OR (x_te = x_tr AND (0.1, 'test') > (0.8, 'train')) THEN 1 ELSE 0 END
         + CASE WHEN x_sh > x_tr OR (x_sh = x_tr AND (0.1, 'shadow') > (0.8, 'train')) THEN 1 ELSE 0 END) AS p_tr,
        (CASE WHEN x_tr > x_te OR (x_tr = x_te AND (0.8, 'train') > (0.1, 'test')) THEN 1 ELSE 0 END
         + CASE WHEN x_sh > x_te OR (x_sh = x_te AND (0.1, 'shadow') > (0.1, 'test')) THEN 1 ELSE 0 END) AS p_te,
        (CASE WHEN x_tr > x_sh OR (x_tr = x_sh AND (0.8, 'train') > (0.1, 'shadow')) THEN 1 ELSE 0 END
         + CASE WHEN x_te > x_sh OR (x_te = x_sh AND (0.1, 'test') > (0.1, 'shadow')) THEN 1 ELSE 0 END) AS p_sh
      FROM f)
SELECT source, lang, n,
       CAST(f_tr + CASE WHEN p_tr < rem THEN 1 ELSE 0 END AS BIGINT) AS n_train,
       CAST(f_te + CASE WHEN p_te < rem THEN 1 ELSE 0 END AS BIGINT) AS n_test,
       CAST(f_sh + CASE WHEN p_sh < rem THEN 1 ELSE 0 END AS BIGINT) AS n_shadow
FROM r""")
def q_split_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C01 + C03: largest-remainder 80/10/10 allocation of every (source, lang) stratum."""
    docs = read_table(spark, sf_dir, "documents")
    counts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return C.allocate_counts_df(counts, "n", C.RATIOS)



def _split_sql() -> str:
    """C06 in SQL: quotas by a recursive fold over strata in key order, then
    each stratum cut train -> test -> shadow in seeded md5 order."""
    ratios = {"tr": (0.8, "train"), "te": (0.1, "test"), "sh": (0.1, "shadow")}
    keys = list(ratios)

    def c01(n, out):  # largest remainder of n over the ratios -> out_tr, out_te, out_sh
        fl = {k: f"floor({n} * {ratios[k][0]})" for k in keys}
        fr = {k: f"({n} * {ratios[k][0]} - {fl[k]})" for k in keys}
        rem = f"({n} - {' - '.join(fl.values())})"
        cols = []
        for s_ in keys:
            ahead = " + ".join(
                f"CASE WHEN {fr[o]} > {fr[s_]} OR ({fr[o]} = {fr[s_]} AND ({ratios[o][0]}, '{ratios[o][1]}') > "
                f"({ratios[s_][0]}, '{ratios[s_][1]}')) THEN 1 ELSE 0 END" for o in keys if o != s_)
            cols.append(f"CAST({fl[s_]} + CASE WHEN ({ahead}) < {rem} THEN 1 ELSE 0 END AS BIGINT) AS {out}_{s_}")
        return ", ".join(cols)

    def ahead(o, s_):  # o is filled before s_: (spare, target, ratio, name) descending
        return (f"(sp_{o} > sp_{s_} OR (sp_{o} = sp_{s_} AND (t_{o}, {ratios[o][0]}, '{ratios[o][1]}') > "
                f"(t_{s_}, {ratios[s_][0]}, '{ratios[s_][1]}')))")
    q = []
    for s_ in keys:
        before = " + ".join(f"CASE WHEN {ahead(o, s_)} THEN sp_{o} ELSE 0 END" for o in keys if o != s_)
        q.append(f"CASE WHEN last THEN r_{s_} ELSE c_{s_} + least(sp_{s_}, greatest(0, dd - ({before}))) END AS q_{s_}")
    return _NORM_SQL.replace("WITH nd AS", "WITH RECURSIVE nd AS", 1) + f""",
st AS (SELECT row_number() OVER (ORDER BY source, coalesce(lang, '')) AS i, source, coalesce(lang, '') AS lang,
              n, {c01('n', 'd')}
       FROM (SELECT source, lang, count(*) AS n FROM n GROUP BY source, lang)),
tot AS (SELECT sum(n) AS n, count(*) AS k FROM st),
tgt AS (SELECT {c01('n', 't')} FROM tot),
fold(i, r_tr, r_te, r_sh, q_tr, q_te, q_sh) AS (
  SELECT 0, t_tr, t_te, t_sh, 0, 0, 0 FROM tgt
  UNION ALL
  SELECT i, r_tr - q_tr, r_te - q_te, r_sh - q_sh, q_tr, q_te, q_sh FROM (
    SELECT i, r_tr, r_te, r_sh, {", ".join(q)} FROM (
      SELECT st.i, st.i = (SELECT k FROM tot) AS last, f.r_tr, f.r_te, f.r_sh,
             t_tr, t_te, t_sh,
             least(st.d_tr, f.r_tr) AS c_tr, least(st.d_te, f.r_te) AS c_te, least(st.d_sh, f.r_sh) AS c_sh,
             f.r_tr - least(st.d_tr, f.r_tr) AS sp_tr, f.r_te - least(st.d_te, f.r_te) AS sp_te,
             f.r_sh - least(st.d_sh, f.r_sh) AS sp_sh,
             st.n - least(st.d_tr, f.r_tr) - least(st.d_te, f.r_te) - least(st.d_sh, f.r_sh) AS dd
      FROM fold f JOIN st ON st.i = f.i + 1 CROSS JOIN tgt))),
quota AS (SELECT st.source, st.lang, q_tr, q_te, q_sh FROM fold JOIN st USING (i)),
pos AS (SELECT n.*, row_number() OVER (PARTITION BY source, coalesce(lang, '')
                 ORDER BY md5('2026:' || sample_id), sample_id) - 1 AS p FROM n),
sp AS (SELECT pos.sample_id, pos.doc_id, pos.source, pos.lang,
         CASE WHEN p < q_tr THEN 'train' WHEN p < q_tr + q_te THEN 'test'
              WHEN p < q_tr + q_te + q_sh THEN 'shadow' END AS split
       FROM pos JOIN quota ON quota.source = pos.source AND quota.lang = coalesce(pos.lang, '')),
splits AS (SELECT * FROM sp WHERE split IS NOT NULL)"""


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = normalized_documents(spark, sf_dir)
    return C.create_splits(n, C.RATIOS, 2026, STRATA)


@register("stratified_split", _split_sql() + """
SELECT sample_id, doc_id, source, lang, split FROM splits""")
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C04 + C06: deterministic stratified train/test/shadow split of the corpus."""
    return stratified_split(spark, sf_dir).select("sample_id", "doc_id", "source", "lang", "split")


@register("split_summary", _split_sql() + """
SELECT split, count(*) AS n FROM splits GROUP BY split""")
def q_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per split."""
    return C.split_summary(stratified_split(spark, sf_dir))


@register("shadow_fallback", _split_sql() + """
SELECT sample_id, doc_id FROM n WHERE sample_id NOT IN (SELECT sample_id FROM splits WHERE split IN ('train', 'test'))""")
def q_shadow_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus rows in neither train nor test."""
    s = stratified_split(spark, sf_dir)
    corpus = normalized_documents(spark, sf_dir).select("sample_id", "doc_id")
    return C.shadow_fallback(corpus, s.where(F.col("split") == "train"),
                             s.where(F.col("split") == "test"), "sample_id")


SUBSET_FRACTION = (3, 5)  # the subset holds 3/5 of the corpus rows


@register("stratified_subset", _NORM_SQL + f""",
tot AS (SELECT count(*) AS n, count(*) * {SUBSET_FRACTION[0]} // {SUBSET_FRACTION[1]} AS size FROM n),
st AS (SELECT source, coalesce(lang, '') AS lang, count(*) AS ns, min(ordinal) AS first FROM n
       GROUP BY source, coalesce(lang, '')),
ex AS (SELECT st.*, ns / (SELECT n FROM tot) * (SELECT size FROM tot) AS exact FROM st),
fl AS (SELECT *, floor(exact) AS q0, exact - floor(exact) AS frac FROM ex),
rk AS (SELECT *, row_number() OVER (ORDER BY frac DESC, ns DESC, first) AS r FROM fl),
quota AS (SELECT source, lang,
            q0 + CASE WHEN r <= (SELECT size FROM tot) - (SELECT sum(q0) FROM fl) THEN 1 ELSE 0 END AS q
          FROM rk),
pos AS (SELECT n.*, row_number() OVER (PARTITION BY source, coalesce(lang, '')
                ORDER BY md5('2026:' || sample_id), sample_id) - 1 AS p FROM n)
SELECT pos.sample_id, pos.doc_id, pos.source, pos.lang
FROM pos JOIN quota ON quota.source = pos.source AND quota.lang = coalesce(pos.lang, '')
WHERE p < q""")
def q_stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact-size (3/5 of the corpus) subset keeping (source, lang)
    proportions, leftovers by largest fraction, then stratum size, then first
    appearance; rows chosen in seeded md5 order inside each stratum."""
    n = normalized_documents(spark, sf_dir)
    size = n.count() * SUBSET_FRACTION[0] // SUBSET_FRACTION[1]
    sub = C.select_subset(n, size, 2026, STRATA)
    return sub.select("sample_id", "doc_id", "source", "lang")


GRAD_SUBSET = 600


@register("gradient_subset", f"""
WITH s AS ({vector_samples_sql()})
SELECT idx FROM s WHERE split = 'train' ORDER BY md5('2026:' || CAST(idx AS VARCHAR)), idx LIMIT {GRAD_SUBSET}""")
def q_gradient_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed-size seeded sample of train rows whose gradients are stored."""
    t = vector_samples(spark, sf_dir).where(F.col("split") == "train").select("idx")
    return C.gradient_subset(t, GRAD_SUBSET, 2026, "idx")


# ---------------------------------------------------------------- X, J01
def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = instruction_records(spark, sf_dir).withColumn(
        "sample_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return X.build_examples(X.full_text(recs), carry=("full_text",))


_EX_SQL = f"""WITH p AS (SELECT conv_id, turn, role, text,
                  lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text FROM conversations),
sy AS (SELECT conv_id, arg_min(text, turn) AS input FROM conversations WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT CAST(p.conv_id AS VARCHAR) || '-' || CAST(p.turn AS VARCHAR) AS sample_id,
             p.text AS instruction, coalesce(sy.input, '') AS input, p.next_text AS output
      FROM p LEFT JOIN sy ON sy.conv_id = p.conv_id WHERE p.role = 'user' AND p.next_role = 'assistant'),
e AS (SELECT sample_id,
        nullif({_strip('instruction')}, '') AS pr, nullif({_strip('input')}, '') AS inp,
        nullif({_strip('output')}, '') AS tg, {_strip('instruction')} AS i0, {_strip('input')} AS n0,
        {_strip('output')} AS o0 FROM r),
ex AS (SELECT sample_id,
        '### Instruction:\n' || CASE WHEN inp IS NOT NULL THEN pr || '\n\nInput:\n' || inp ELSE pr END
          || '\n\n### Response:\n' AS prompt,
        tg AS target,
        CASE WHEN n0 <> '' THEN 'Instruction: ' || i0 || '\nInput: ' || n0 || '\nResponse: ' || o0
             ELSE 'Instruction: ' || i0 || '\nResponse: ' || o0 END AS full_text
      FROM e)"""

@register("training_examples", _EX_SQL.replace("\\n", "\n") + """
SELECT sample_id, prompt, target, prompt || target AS text, full_text FROM ex""")
def q_training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templated prompt/target/text and the attribution full text
    for every user -> assistant turn pair."""
    return examples(spark, sf_dir).select("sample_id", "prompt", "target", "text", "full_text")


MAX_LEN = 128
VOCAB = 32000


def _tokens(spark, sf_dir, padding="max_length"):
    return X.tokenize(examples(spark, sf_dir), MAX_LEN, padding, VOCAB)


_TOK_SQL = _EX_SQL.replace("\\n", "\n") + f""",
tx AS (SELECT sample_id, prompt || target AS text FROM ex),
tk AS (SELECT sample_id, list_transform(
          list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')[1:{MAX_LEN}],
          lambda t: CAST((('0x' || substr(md5(t), 1, 8))::BIGINT % {VOCAB}) AS INTEGER)) AS ids FROM tx)"""


@register("example_tokens", _TOK_SQL + f"""
SELECT sample_id, CAST(len(ids) AS INTEGER) AS n_tokens,
       array_to_string(list_concat(ids, list_transform(range(greatest({MAX_LEN} - len(ids), 0)), lambda x: 0)), ',')
         AS input_ids,
       CAST(len(ids) AS BIGINT) AS seq_len FROM tk""")
def q_example_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed whitespace tokens, truncated and padded to 128 with
    a zero mask on padding; effective length from the mask."""
    t = L.effective_length(_tokens(spark, sf_dir))
    return t.select("sample_id",
                    F.size(F.filter("attention_mask", lambda m: m == 1)).alias("n_tokens"),
                    F.concat_ws(",", F.transform("input_ids", lambda x: x.cast("string"))).alias("input_ids"),
                    "seq_len")


@register("padding_footprint", _TOK_SQL + f""",
pl AS (SELECT len(ids) AS seq_len, row_number() OVER (ORDER BY sample_id) - 1 AS pos FROM tk),
b AS (SELECT floor(pos / 4) AS batch, max(seq_len) AS mx, count(*) AS rows FROM pl GROUP BY 1)
SELECT CAST(sum(least(mx, {MAX_LEN}) * rows) AS BIGINT) AS padded_tokens,
       CAST(sum(rows) * {MAX_LEN} AS BIGINT) AS max_length_tokens,
       round(sum(least(mx, {MAX_LEN}) * rows) / (sum(rows) * {MAX_LEN}), 6) AS ratio,
       CAST((SELECT sum(seq_len) FROM pl) AS BIGINT) AS n_tokens FROM b""")
def q_padding_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T02 + T07: token footprint of dynamic padding in contiguous batches of 4
    versus padding every row to 128, plus the non-pad token count."""
    from trainlens.plans.ordinal import with_ordinal
    t = L.effective_length(_tokens(spark, sf_dir, "longest"))
    t = with_ordinal(t.select("sample_id", "seq_len"), [F.col("sample_id")], "pos")
    fp = L.padding_footprint(t, 4, MAX_LEN)
    return fp.select(F.col("padded_tokens").cast("long").alias("padded_tokens"),
                     F.col("max_length_tokens").cast("long").alias("max_length_tokens"),
                     r6("ratio"), F.col("n_tokens").cast("long").alias("n_tokens"))


@register("dataset_fingerprint", """
WITH h AS (SELECT CAST('0x' || substr(md5('v' || strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR)
                  || coalesce('v' || strlen(text) || ':' || text, 'n')), 1, 15) AS BIGINT) AS h FROM documents)
SELECT count(*) AS n_rows, bit_xor(h) AS xor_hash, CAST(sum(CAST(h AS HUGEINT)) % 2305843009213693952 AS BIGINT) AS sum_hash
FROM h""")
def q_dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: order-independent content fingerprint of the corpus (cache key part)."""
    d = read_table(spark, sf_dir, "documents")
    return X.dataset_fingerprint(d, ["doc_id", "text"])


# ---------------------------------------------------------------- joins and audits
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratified split as a manifest: sample_id, doc_id, split, pos."""
    return C.with_split_positions(stratified_split(spark, sf_dir).select("sample_id", "doc_id", "split"))


_MANIFEST_SQL = _split_sql() + """,
mf AS (SELECT sample_id, doc_id, split, row_number() OVER (PARTITION BY split ORDER BY
         md5(CASE split WHEN 'train' THEN '2027' WHEN 'test' THEN '2028' ELSE '2029' END || ':' || sample_id), sample_id) - 1 AS pos
       FROM splits)"""


@register("manifest_records", _MANIFEST_SQL + """
SELECT mf.sample_id, mf.split, CAST(mf.pos AS BIGINT) AS pos, d.lang, d.n_chars, CAST(strlen(d.text) AS INTEGER) AS n_bytes
FROM mf JOIN documents d USING (doc_id)""")
def q_manifest_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split manifest joined to its records, manifest order kept."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.octet_length("text").alias("n_bytes"))
    return X.join_manifest(manifest(spark, sf_dir), docs, "doc_id").select("sample_id", "split", "pos", "lang", "n_chars", "n_bytes")


@register("manifest_unknown_ids", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def q_manifest_unknown_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (as a manifest) that the table of labels doesn't know."""
    return X.unknown_ids(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), "doc_id")


@register("split_leak", _split_sql() + f""",
so AS ({vector_samples_sql()})
SELECT DISTINCT doc_id FROM splits WHERE split = 'test' AND doc_id IN (SELECT idx FROM so WHERE split = 'train')""")
def q_split_leak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the test part of the stratified split whose vector is
    in the train part of the vector split."""
    test = stratified_split(spark, sf_dir).where("split = 'test'").select("doc_id")
    train = vector_samples(spark, sf_dir).where("split = 'train'").select(F.col("idx").alias("doc_id"))
    return C.split_overlap(test, train, "doc_id")


@register("subset_positions", _MANIFEST_SQL + f""",
sb AS (SELECT doc_id FROM (SELECT vec_id AS doc_id FROM embeddings) ORDER BY md5('2026:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT {GRAD_SUBSET})
SELECT sb.doc_id, CAST(mf.pos AS BIGINT) AS pos FROM sb LEFT JOIN (SELECT * FROM mf WHERE split = 'train') mf USING (doc_id)""")
def q_subset_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded sample of vector ids with their place in the train
    manifest (null where they aren't in it)."""
    ids = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    subset = C.gradient_subset(ids, GRAD_SUBSET, 2026, "doc_id")
    return X.subset_positions(subset, manifest(spark, sf_dir).where("split = 'train'"), "doc_id")


FIRST = {"train": 40, "test": 5, "shadow": 3}


@register("first_rows_per_split", _MANIFEST_SQL + f"""
SELECT sample_id, split, CAST(pos AS BIGINT) AS pos FROM mf
WHERE pos < CASE split {' '.join(f"WHEN '{s}' THEN {n}" for s, n in FIRST.items())} END""")
def q_first_rows_per_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of every split by manifest position."""
    return C.first_n_per_split(manifest(spark, sf_dir), FIRST).select("sample_id", "split", "pos")


@register("split_by_counts", """
SELECT 'train' AS split, CAST(count(*) - 30 AS BIGINT) AS n FROM documents
UNION ALL SELECT 'test', 20 UNION ALL SELECT 'shadow', 10""")
def q_split_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a split with explicit counts (all but 30, 20 and 10 rows)."""
    n = normalized_documents(spark, sf_dir)
    total = read_table(spark, sf_dir, "documents").count()
    return C.split_summary(C.create_splits(n, by=STRATA, target_counts={"train": total - 30, "test": 20, "shadow": 10}))


@register("coerced_records", """
SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
       coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars FROM documents""")
def q_coerced_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field as a string, nulls empty."""
    return N.coerce_to_strings(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))


_ASKED_SQL = _EX_SQL.replace("\\n", "\n").split("e AS (")[0].replace(
    "WHERE p.role = 'user' AND p.next_role = 'assistant')", "WHERE p.role = 'user')").replace(
    "p.next_text AS output", "CASE WHEN p.next_role = 'assistant' THEN p.next_text END AS output")


@register("example_errors", _ASKED_SQL + f"""
e AS (SELECT sample_id, nullif({_strip('instruction')}, '') AS pr, nullif({_strip('output')}, '') AS tg FROM r)
SELECT sample_id, tg AS response,
       CASE WHEN pr IS NULL THEN 'Sample ''' || sample_id || ''' is missing prompt text (prompt_field=''instruction'')'
            WHEN tg IS NULL THEN 'Sample ''' || sample_id
              || ''' is missing target answer (tested_fields=[''output'', ''response'', ''completion'', ''target''])' END AS error
FROM e""")
def q_example_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X03 + X05: every user turn as an example with its response; those without
    a prompt or an answer carry the error."""
    recs = instruction_records(spark, sf_dir, answered=False).withColumn(
        "sample_id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return X.build_examples(recs, with_response=True).select("sample_id", "response", "error")


@register("tensor_violations", _TOK_SQL + f"""
SELECT sample_id, 'length differs from max_length={MAX_LEN}' AS reason FROM tk WHERE len(ids) <> {MAX_LEN}
UNION ALL SELECT sample_id, 'input_ids is empty' FROM tk WHERE len(ids) = 0""")
def q_tensor_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unpadded token rows held against the fixed-length rule."""
    return X.tensor_violations(_tokens(spark, sf_dir, "longest"), "max_length", MAX_LEN)
