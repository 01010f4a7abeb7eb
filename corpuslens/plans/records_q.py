"""Filter and record-preparation queries (F1-F11, F14, J6, J12, J13, A13-A17,
A42, W6, K6, K8, K11, X6, U1-U4, S1, S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import first_paragraphs, last_period_prefix
from ..operators import descriptive as D
from ..operators import filters as FL
from ..operators import lemmas as LM
from ..operators import ranking as R
from ..operators import records as RC
from ..operators.search import entity_mentions
from ..sources import corpus as S
from ..session import join_scalars, materialise
from . import roles
from .catalog import ws, register

_SW = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in FL.ENGLISH_STOPWORDS) + "]"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _norm_sql(x: str) -> str:
    t = _STRIP.format(x=f"lower(regexp_replace({x}, '[^a-zA-Z\\s]', '', 'g'))")
    return f"array_to_string(list_filter({ws(t)}, lambda w: NOT list_contains({_SW}, w)), ' ')"


@register("normalise_text", f"SELECT doc_id, {_norm_sql('text')} AS norm FROM documents")
def normalise_text(spark, sf):
    d = roles.documents(spark, sf)
    return d.select("doc_id", FL.normalise_text(F.col("text")).alias("norm"))


_FORMS = "list_filter([" + ", ".join(f"CASE WHEN ends_with(w, '{e}') THEN left(w, length(w) - {len(e)}) || '{n}' END" for e, n in LM.DETACHMENTS) + f"], lambda f: f IS NOT NULL AND length(f) >= {LM.LEAST})"


@register("normalise_lemmas", f"""
WITH n AS (SELECT doc_id, {_norm_sql('text')} AS norm FROM documents),
w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(norm, ' ')) AS w FROM n) WHERE w <> ''),
c AS (SELECT w, unnest({_FORMS}) AS form FROM w),
l AS (SELECT c.w, min({{'n': length(form), 'f': form}}) AS m FROM c JOIN w k ON c.form = k.w GROUP BY c.w),
t AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(norm, ' ')) AS x, unnest(range(len(string_split(norm, ' ')))) AS i FROM n))
SELECT doc_id, string_agg(CASE WHEN m.n <= length(x) THEN m.f ELSE x END, ' ' ORDER BY i) AS norm FROM t LEFT JOIN l ON t.x = l.w GROUP BY doc_id""")
def normalise_lemmas(spark, sf):
    return LM.normalise_documents(roles.documents(spark, sf).select("doc_id", "text")).select("doc_id", "norm")


def _maxcount_sql(x: str) -> str:
    return f"coalesce((SELECT max(c) FROM (SELECT count(*) AS c FROM unnest({ws(x)}) t(w) GROUP BY w)), 0)"


@register("repetition_gate", f"""
SELECT doc_id, {_maxcount_sql('text')} <= len({ws('text')}) * 0.15 AND {_maxcount_sql('text')} <= 20 AS ok
FROM documents""")
def repetition_gate(spark, sf):
    d = roles.documents(spark, sf)
    return d.select("doc_id", FL.repetition_ok(F.col("text")).alias("ok"))


_NOISY_SQL = """(SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'None. ' || text || ' None None trailing words'
                               WHEN doc_id % 7 = 1 THEN text || ' None.' ELSE text END AS text FROM documents)"""


def _noisy(spark, sf):
    d = roles.documents(spark, sf)
    return d.select("doc_id", F.when(F.col("doc_id") % 7 == 0,
                                     F.concat(F.lit("None. "), "text", F.lit(" None None trailing words")))
                    .when(F.col("doc_id") % 7 == 1, F.concat("text", F.lit(" None.")))
                    .otherwise(F.col("text")).alias("text"))


_CLEAN = "replace(split_part(replace(text, 'None.', ''), 'None None', 1), 'None.', '')"


@register("discard_filter", f"""
WITH c AS (SELECT doc_id, {_CLEAN} AS text FROM {_NOISY_SQL}),
n AS (SELECT doc_id, text, {_norm_sql(_STRIP.format(x="regexp_replace(text, '\\s+', ' ', 'g')"))} AS norm FROM c)
SELECT doc_id, md5(text) AS text_md5,
  CASE WHEN len(list_distinct({ws('lower(norm)')})) <= 20 THEN 'few_distinct_words'
       WHEN length(norm) < 400 THEN 'too_short'
       WHEN NOT ({_maxcount_sql('text')} <= len({ws('text')}) * 0.15 AND {_maxcount_sql('text')} <= 20) THEN 'repetitive'
  END AS reason,
  CASE WHEN len(list_distinct({ws('lower(norm)')})) <= 20 OR length(norm) < 400
         OR NOT ({_maxcount_sql('text')} <= len({ws('text')}) * 0.15 AND {_maxcount_sql('text')} <= 20)
       THEN false ELSE true END AS keep
FROM n""")
def discard_filter(spark, sf):
    out = FL.discard_filter(_noisy(spark, sf), "text")
    return out.select("doc_id", F.md5("text").alias("text_md5"), "reason", "keep")


@register("truncate_last_period", r"""
SELECT doc_id, md5(coalesce(regexp_extract(text, '(?s)^(.*\.)', 1), '')) AS text_md5,
       length(coalesce(regexp_extract(text, '(?s)^(.*\.)', 1), '')) AS n_chars FROM documents""")
def truncate_last_period(spark, sf):
    d = roles.documents(spark, sf).select("doc_id", last_period_prefix(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("text_md5"), F.length("t").alias("n_chars"))


@register("length_filter", f"""
SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 5 AND len({ws('text')}) < 750""")
def length_filter(spark, sf):
    return FL.length_filters(roles.documents(spark, sf), "text", min_chars=5, max_tokens=750).select("doc_id")


@register("first_paragraphs", r"""
SELECT doc_id, md5(h) AS head_md5, length(h) AS n_chars FROM (
  SELECT doc_id, regexp_replace(array_to_string(list_slice(string_split(text, chr(10)), 1, 6), chr(10)),
                                '^\s+|\s+$', '', 'g') AS h FROM documents)""")
def first_paragraphs_q(spark, sf):
    d = roles.documents(spark, sf).select("doc_id", first_paragraphs(F.col("text"), 6).alias("h"))
    return d.select("doc_id", F.md5("h").alias("head_md5"), F.length("h").alias("n_chars"))


@register("first_per_subject", """
SELECT user_id, arg_min(event_id, event_id) AS event_id, arg_min(event_type, event_id) AS event_type,
       arg_min(value, event_id) AS value FROM events GROUP BY user_id""")
def first_per_subject(spark, sf):
    ev = roles.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return RC.first_per_key(ev, "user_id", "event_id")


_CODES_SQL = """(SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey) AS codes
                 FROM lineitem GROUP BY l_orderkey)"""


def _codes(spark, sf):
    li = roles.table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("_o"),
                                                  F.col("l_partkey").cast("string").alias("code"))
    return RC.group_records(li, "l_orderkey", "_o", [], ["code"]).withColumnRenamed("code", "codes")


# the most frequent codes; of equal counts the one that appears first
_TOP_SQL = f"""
SELECT value, count(*) AS cnt, min(l_orderkey * 1000 + place) AS seen FROM (
  SELECT l_orderkey, unnest(codes) AS value, unnest(range(0, len(codes))) AS place FROM {_CODES_SQL}) GROUP BY value
ORDER BY cnt DESC, seen LIMIT 10"""


@register("top_codes", f"""
SELECT value, cnt, row_number() OVER (ORDER BY cnt DESC, seen) AS rank FROM ({_TOP_SQL})""")
def top_codes(spark, sf):
    return RC.top_k_values(_codes(spark, sf), "codes", 10, "l_orderkey")


@register("keep_top_codes", f"""
WITH top AS (SELECT list(value) AS t FROM ({_TOP_SQL}))
SELECT l_orderkey, array_to_string(list_filter(codes, lambda x: list_contains(t, x)), ',') AS codes
FROM {_CODES_SQL}, top WHERE len(list_intersect(codes, t)) > 0""")
def keep_top_codes(spark, sf):
    out = RC.keep_top_codes(_codes(spark, sf), "codes", 10, "l_orderkey")
    return out.select("l_orderkey", F.array_join("codes", ",").alias("codes"))


@register("clinical_records", """
WITH j AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, CAST(l.l_partkey AS VARCHAR) AS code, p.p_name AS title,
                  c.c_mktsegment, n.n_name
           FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
           JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
           JOIN part p ON l.l_partkey = p.p_partkey)
SELECT l_orderkey, arg_min(c_mktsegment, l_linenumber) AS segment, arg_min(n_name, l_linenumber) AS nation,
       md5('Long_Title: ' || array_to_string(list(title ORDER BY l_linenumber, l_partkey), ', ') || ' ICD9_Code: '
           || array_to_string(list(code ORDER BY l_linenumber, l_partkey), ', ') || ' ' || chr(10) || 'Gender: '
           || CASE arg_min(substr(c_mktsegment, 1, 1), l_linenumber) WHEN 'M' THEN 'Male' WHEN 'F' THEN 'Female'
              ELSE 'Other' END
           || ' Ethnicity: ' || arg_min(n_name, l_linenumber) || ' ' || chr(10) || 'Text: ') AS record_md5
FROM j GROUP BY l_orderkey""")
def clinical_records(spark, sf):
    t = lambda n: roles.table(spark, sf, n)
    li, o, c, n, p = t("lineitem"), t("orders"), t("customer"), t("nation"), t("part")
    j = (li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
         .join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(p, li.l_partkey == p.p_partkey)
         .select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("_o"),
                 F.col("l_partkey").cast("string").alias("code"),
                 F.col("p_name").alias("title"), "c_mktsegment", "n_name"))
    g = RC.group_records(j, "l_orderkey", "_o", ["c_mktsegment", "n_name"], ["title", "code"])
    rec = RC.structured_record(F.col("title"), F.col("code"), F.substring("c_mktsegment", 1, 1), F.col("n_name"))
    return g.select("l_orderkey", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"),
                    F.md5(rec).alias("record_md5"))


@register("control_prompts", """
SELECT o.o_orderkey, 'Diagnosis: ' || 'Countries: ' || n.n_name || ', Year: ' || CAST(year(o.o_orderdate) AS VARCHAR)
       || ' Summary :' AS prompt
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def control_prompts(spark, sf):
    t = lambda n: roles.table(spark, sf, n)
    o, c, n = t("orders"), t("customer"), t("nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.select("o_orderkey", RC.build_prompt(RC.control_code(F.col("n_name"), F.year("o_orderdate")),
                                                  "mimic").alias("prompt"))


def _annotated(spark, sf):
    """Nested annotations derived from the rule recogniser: annotator a1 gets
    every mention, a2 the e-mail ones; PROPER -> PERSON/DIRECT, others
    DATETIME/QUASI or CODE/NO_MASK."""
    m = D.extract_entities(roles.documents(spark, sf))
    etype = F.when(F.col("label") == "PROPER", "PERSON").when(F.col("label") == "NUMBER", "DATETIME") \
        .otherwise("CODE")
    itype = F.when(F.col("label") == "PROPER", "DIRECT").when(F.col("label") == "NUMBER", "QUASI") \
        .otherwise("NO_MASK")
    ms = m.select("doc_id", "pos", "label", F.struct(etype.alias("entity_type"), itype.alias("identifier_type"),
                                                     F.col("entity").alias("span_text")).alias("m"))
    mentions = F.array_sort(F.collect_list(F.struct("pos", "label", "m")))
    rows = ms.groupBy("doc_id").agg(mentions.alias("a1")).withColumn("a2", F.filter("a1", lambda x: x["label"] == "EMAIL"))
    ann = lambda k: F.struct(F.lit(k).alias("k"), F.struct(F.transform(k, lambda x: x["m"]).alias("entity_mentions")))
    anns = rows.select("doc_id", F.map_from_entries(F.concat(F.array(ann("a1")), F.filter(F.array(ann("a2")), lambda _: F.size("a2") > 0))).alias("annotations"))
    return roles.documents(spark, sf).select("doc_id", "text").join(anns, "doc_id")


_RULES = D.rules_pattern()
_LABELS = " ".join(f"WHEN regexp_full_match(entity, '{pattern}') THEN '{name}'" for name, pattern in D.ENTITY_RULES)
_ANN_SQL = f"""
ml AS (SELECT doc_id, text, regexp_extract_all(text, '{_RULES}') AS l FROM documents),
mm AS (SELECT doc_id, text, pos, entity,
              CASE {_LABELS} END AS label
       FROM (SELECT doc_id, text, unnest(range(0, len(l))) AS pos, unnest(l) AS entity FROM ml)),
am AS (SELECT doc_id, text, 'a1' AS annotator, pos, entity, label FROM mm
       UNION ALL SELECT doc_id, text, 'a2', row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1, entity, label
       FROM mm WHERE label = 'EMAIL'),
ann AS (SELECT doc_id, text, annotator, pos, entity AS span_text,
               CASE label WHEN 'PROPER' THEN 'PERSON' WHEN 'NUMBER' THEN 'DATETIME' ELSE 'CODE' END AS entity_type,
               CASE label WHEN 'PROPER' THEN 'DIRECT' WHEN 'NUMBER' THEN 'QUASI' ELSE 'NO_MASK' END AS identifier_type
        FROM am)
"""


@register("annotation_mentions", "WITH " + _ANN_SQL + """
SELECT doc_id, annotator, pos, entity_type, identifier_type, span_text FROM ann
WHERE entity_type IN ('PERSON', 'DATETIME')""")
def annotation_mentions(spark, sf):
    return RC.annotation_mentions(_annotated(spark, sf), types=["PERSON", "DATETIME"])


_LINES_SQL = _ANN_SQL + r""",
hd AS (SELECT DISTINCT doc_id, regexp_replace(array_to_string(list_slice(string_split(text, chr(10)), 1, 6), chr(10)),
                                     '^\s+|\s+$', '', 'g') AS head FROM ann),
f AS (SELECT a.doc_id, a.pos, a.entity_type, a.span_text FROM ann a JOIN hd USING (doc_id)
      WHERE a.annotator = 'a1' AND a.identifier_type IN ('DIRECT', 'QUASI') AND contains(hd.head, a.span_text)),
pt AS (SELECT doc_id, min(pos) AS first, entity_type || ': ' || array_to_string(list(span_text ORDER BY pos), ', ') AS line
       FROM f GROUP BY doc_id, entity_type),
cl AS (SELECT doc_id, array_to_string(list(line ORDER BY first), chr(10)) AS control_codes FROM pt GROUP BY doc_id)
"""


@register("control_code_lines", "WITH " + _LINES_SQL + "SELECT doc_id, control_codes FROM cl")
def control_code_lines(spark, sf):
    return RC.control_code_lines(_annotated(spark, sf))


@register("control_code_leakage", "WITH " + _LINES_SQL + r""",
ents AS (SELECT doc_id, regexp_replace(e, '^\s+|\s+$', '', 'g') AS entity
         FROM (SELECT doc_id, unnest(string_split(v, ',')) AS e FROM (
               SELECT doc_id, unnest(regexp_extract_all(control_codes,
                 '(?m)^(CODE|PERSON|DATETIME|LOC|ORG|DEM|QUANTITY|MISE):\s*(.*)$', 2)) AS v FROM cl))),
d AS (SELECT doc_id, text FROM documents WHERE CAST(substr(source, 4) AS INTEGER) >= 10),
pats AS (SELECT row_number() OVER () AS entity_id, entity, '(?i)' ||
    CASE WHEN regexp_matches(entity, '^[\p{L}\p{N}_]') THEN '(^|[^\p{L}\p{N}_])' ELSE '[\p{L}\p{N}_]' END ||
    regexp_escape(entity) ||
    CASE WHEN regexp_matches(entity, '[\p{L}\p{N}_]$') THEN '($|[^\p{L}\p{N}_])' ELSE '[\p{L}\p{N}_]' END AS pat
  FROM (SELECT DISTINCT entity FROM ents WHERE entity <> '')),
cand AS MATERIALIZED (SELECT d.doc_id, d.text, p.entity, p.pat FROM d JOIN pats p ON contains(lower(d.text), lower(p.entity)))
SELECT (SELECT count(*) FROM pats) AS n_entities,
       (SELECT count(DISTINCT entity) FROM cand WHERE regexp_matches(text, pat)) AS n_leaked""")
def control_code_leakage(spark, sf):
    codes = RC.control_code_lines(_annotated(spark, sf))
    ents = RC.parse_control_codes(codes).filter(F.col("entity") != "").select("entity").distinct() \
        .withColumn("entity_id", F.xxhash64("entity"))
    ents = materialise(ents, "control-entities")  # the search and both counts read them
    hits = entity_mentions(roles.syn_docs(spark, sf), ents, key="neighbours")
    return join_scalars(ents.agg(F.count("*").alias("n_entities")),
                        hits.agg(F.count_distinct("entity").alias("n_leaked")))


@register("author_mapping", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position,
       count(*) OVER (PARTITION BY user_id) AS n_records FROM events""")
def author_mapping(spark, sf):
    ev = roles.table(spark, sf, "events")
    return RC.author_mapping(ev, "user_id", "event_id")


@register("round_robin", """
WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events),
d AS (SELECT DISTINCT user_id, n, unnest(range(0, 5)) AS k FROM m)
SELECT d.user_id, d.k, (d.k % d.n) + 1 AS position, m.event_id FROM d JOIN m ON m.user_id = d.user_id
AND m.position = (d.k % d.n) + 1""")
def round_robin(spark, sf):
    ev = roles.table(spark, sf, "events")
    draws = ev.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    return RC.round_robin(ev, "user_id", "event_id", draws)


@register("poisson_sample", """
WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS position,
                  count(*) OVER (PARTITION BY user_id) AS n FROM events),
a AS (SELECT DISTINCT user_id, n FROM m),
d AS (SELECT user_id, n, r, row_number() OVER (PARTITION BY user_id ORDER BY r) - 1 AS k
      FROM (SELECT user_id, n, unnest(range(0, 5)) AS r FROM a)
      WHERE ('0x' || substr(md5('0:' || CAST(user_id AS VARCHAR) || ':' || CAST(r AS VARCHAR)), 1, 8))::BIGINT
            / 4294967296.0 < 0.1)
SELECT d.r AS round, d.user_id, m.event_id FROM d JOIN m ON m.user_id = d.user_id AND m.position = (d.k % d.n) + 1""")
def poisson_sample(spark, sf):
    ev = roles.table(spark, sf, "events")
    return RC.poisson_author_sample(ev, "user_id", "event_id", q=0.1, rounds=5)


@register("repeat_rows", """
SELECT item_id, unnest(range(0, 3)) AS seq_no, 'Generate a biography about: ' || CAST(item_id AS VARCHAR)
       || ' Biography :' AS prompt FROM benchmark""")
def repeat_rows(spark, sf):
    b = roles.table(spark, sf, "benchmark").select("item_id", RC.build_prompt(F.col("item_id"), "wiki").alias("prompt"))
    return RC.repeat_rows(b, 3)


@register("bootstrap_sample", """
WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS rank, count(*) OVER () AS n FROM labels),
d AS (SELECT i AS draw, ('0x' || substr(md5('42:' || CAST(i AS VARCHAR)), 1, 8))::BIGINT AS h FROM range(0, 1000) t(i))
SELECT doc_id, quality, draw FROM d JOIN r ON r.rank = d.h % r.n + 1""")
def bootstrap_sample(spark, sf):
    lab = roles.table(spark, sf, "labels").select("doc_id", "quality")
    return R.bootstrap_sample(lab, "doc_id", 1000)


@register("pick_positions", """
WITH el AS (SELECT doc_id FROM documents WHERE doc_id <> (SELECT max(doc_id) FROM documents))
SELECT doc_id, pick FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS pick
                          FROM el) WHERE pick <= 50""")
def pick_positions(spark, sf):
    return R.pick_positions(roles.documents(spark, sf).select("doc_id"), "doc_id", 50)


_SPLIT = """(SELECT doc_id, CASE WHEN r <= ceil(ceil(n * 0.2) * 0.5) THEN 'test' WHEN r <= ceil(n * 0.2)
             THEN 'validation' ELSE 'train' END AS split
             FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS r,
                          count(*) OVER () AS n FROM documents))"""


@register("augmented_training_set", f"""
SELECT s.doc_id, 'real' AS origin FROM {_SPLIT} s JOIN documents d USING (doc_id)
WHERE s.split = 'train' AND CAST(substr(d.source, 4) AS INTEGER) < 10
UNION ALL
SELECT doc_id, 'synthetic' FROM documents WHERE CAST(substr(source, 4) AS INTEGER) >= 10""")
def augmented_training_set(spark, sf):
    docs = roles.documents(spark, sf)
    sp = R.exact_split(docs.select("doc_id"), "doc_id")
    real_train = sp.filter(F.col("split") == "train").join(docs.filter(~roles.is_syn()).select("doc_id"), "doc_id") \
        .select("doc_id", F.lit("real").alias("origin"))
    synth = docs.filter(roles.is_syn()).select("doc_id", F.lit("synthetic").alias("origin"))
    return real_train.unionByName(synth)


@register("heldout_minus_sample", f"""
SELECT doc_id FROM {_SPLIT} WHERE split IN ('test', 'validation')
  AND doc_id NOT IN (SELECT doc_id FROM documents ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)) LIMIT 100)""")
def heldout_minus_sample(spark, sf):
    docs = roles.documents(spark, sf).select("doc_id")
    held = R.exact_split(docs, "doc_id").filter(F.col("split").isin("test", "validation")).select("doc_id")
    return held.join(R.seeded_sample(docs, "doc_id", 100, seed=0), "doc_id", "left_anti")


@register("pack_prompt_target", f"""
WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM benchmark),
c AS (SELECT item_id, list_slice(ids, 1, 5) AS ctx, list_slice(ids, 6, len(ids)) AS tgt FROM t),
p AS (SELECT item_id, list_concat(ctx, tgt) AS x,
             list_concat([-100 for _ in range(len(ctx))], tgt) AS lab FROM c),
q AS (SELECT item_id, x, lab, greatest(16 - len(x), 0) AS pad FROM p)
SELECT item_id,
  array_to_string(list_slice(list_concat([0 for _ in range(pad)], x), 1, 16), ',') AS input_ids,
  array_to_string(list_slice(list_concat([-100 for _ in range(pad)], lab), 1, 16), ',') AS labels,
  array_to_string(list_slice(list_concat([0 for _ in range(pad)], [1 for _ in range(len(x))]), 1, 16), ',') AS attention_mask
FROM q""")
def pack_prompt_target(spark, sf):
    b = roles.table(spark, sf, "benchmark").select(
        "item_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"))
    ctx = F.slice("ids", 1, 5)
    tgt = F.slice("ids", 6, F.greatest(F.size("ids") - 5, F.lit(0)))
    ids, lab, mask = RC.pack_prompt_target(ctx, tgt, 16)
    return b.select("item_id", F.array_join(ids, ",").alias("input_ids"), F.array_join(lab, ",").alias("labels"),
                    F.array_join(mask, ",").alias("attention_mask"))


@register("aligned_corpora", """
WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents
           WHERE CAST(substr(source, 4) AS INTEGER) >= 10),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents
      WHERE CAST(substr(source, 4) AS INTEGER) < 10 AND length(text) < 3000),
n AS (SELECT least((SELECT count(*) FROM s), (SELECT count(*) FROM r)) AS n)
SELECT 'synthetic' AS side, doc_id, r AS position FROM s, n WHERE r <= n
UNION ALL SELECT 'real', doc_id, r FROM r, n WHERE r <= n""")
def aligned_corpora(spark, sf):
    syn, real = S.align_corpora(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf), max_real_chars=3000)
    return syn.select(F.lit("synthetic").alias("side"), "doc_id", "position").unionByName(
        real.select(F.lit("real").alias("side"), "doc_id", "position"))


@register("load_corpus", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def load_corpus(spark, sf):
    return S.load_corpus(spark, f"{sf.rstrip('/')}/documents.parquet", fmt="parquet")
