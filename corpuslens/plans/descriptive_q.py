"""Descriptive and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.treebank import treebank_sql
from ..operators import descriptive as D
from ..operators import sentences as SE
from ..operators import similarity as S
from . import roles
from .catalog import REF, SYN, register, sentences_sql, ws

_RULES = D.rules_pattern()
_LABEL = "CASE " + " ".join(
    f"WHEN regexp_full_match(entity, '{p}') THEN '{n}'" for n, p in D.ENTITY_RULES) + " END"

MENTIONS = f"""
ml AS (SELECT doc_id, regexp_extract_all(text, '{_RULES}') AS l FROM documents),
mentions AS (
  SELECT doc_id, pos, entity, {_LABEL} AS label FROM (
    SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS entity FROM ml))
"""
COUNTS = MENTIONS + """,
counts AS (SELECT entity, count(*) AS cnt, min({'d': doc_id, 'p': pos}) AS f FROM mentions GROUP BY entity),
c AS (SELECT entity, cnt, f.d AS first_doc, f.p AS first_pos FROM counts)
"""


def _mentions(spark, sf):
    return D.extract_entities(roles.documents(spark, sf))


@register("entity_mentions_rules", "WITH " + MENTIONS + "SELECT doc_id, pos, entity, label FROM mentions")
def entity_mentions_rules(spark, sf):
    return _mentions(spark, sf)


@register("entity_counts", "WITH " + COUNTS + "SELECT * FROM c")
def entity_counts(spark, sf):
    return D.entity_counts(_mentions(spark, sf))


_TOP = "(SELECT * FROM c ORDER BY cnt DESC, first_doc, first_pos LIMIT 10)"
_LEAST = """(SELECT * FROM c, (SELECT max(cnt) AS t FROM (SELECT cnt FROM c ORDER BY cnt LIMIT 10))
            WHERE cnt <= t ORDER BY first_doc, first_pos LIMIT 10)"""


@register("entity_top", "WITH " + COUNTS + f"""
SELECT entity, cnt, first_doc, first_pos, row_number() OVER (ORDER BY cnt DESC, first_doc, first_pos) AS rank
FROM {_TOP}""")
def entity_top(spark, sf):
    return D.top_entities(D.entity_counts(_mentions(spark, sf)), 10)


@register("entity_least", "WITH " + COUNTS + f"""
SELECT entity, cnt, first_doc, first_pos, row_number() OVER (ORDER BY first_doc, first_pos) AS rank
FROM {_LEAST}""")
def entity_least(spark, sf):
    return D.least_entities(D.entity_counts(_mentions(spark, sf)), 10).drop("_thr")


@register("entity_report", "WITH " + COUNTS + f"""
SELECT 'most' AS kind, row_number() OVER (ORDER BY cnt DESC, first_doc, first_pos) AS rank, entity, cnt FROM {_TOP}
UNION ALL
SELECT 'least', row_number() OVER (ORDER BY first_doc, first_pos), entity, cnt FROM {_LEAST}""")
def entity_report(spark, sf):
    return D.entity_report(D.entity_counts(_mentions(spark, sf)), 10, 10)


_TOK = r"[\p{L}\p{N}_]+(?:[-.@''][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]"
NGRAMS = f"""
tk AS (SELECT doc_id, regexp_extract_all(lower(text), '{_TOK}') AS t FROM documents),
gl AS (SELECT doc_id, list_transform(range(0, len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2]) AS g FROM tk),
grams AS (SELECT doc_id, unnest(range(0, len(g))) AS pos, unnest(g) AS ngram FROM gl),
gc AS (SELECT ngram, count(*) AS cnt, min({{'d': doc_id, 'p': pos}}) AS f FROM grams GROUP BY ngram),
c AS (SELECT ngram, cnt, f.d AS first_doc, f.p AS first_pos FROM gc)
"""


@register("ngram_counts", "WITH " + NGRAMS + "SELECT * FROM c")
def ngram_counts(spark, sf):
    return D.ngram_counts(roles.documents(spark, sf), 2)


@register("ngram_extremes", "WITH " + NGRAMS + """
SELECT 'most' AS kind, row_number() OVER (ORDER BY cnt DESC, first_doc, first_pos) AS rank, ngram, cnt
FROM (SELECT * FROM c ORDER BY cnt DESC, first_doc, first_pos LIMIT 5)
UNION ALL
SELECT 'least', row_number() OVER (ORDER BY cnt, first_doc DESC, first_pos DESC), ngram, cnt
FROM (SELECT * FROM c ORDER BY cnt, first_doc DESC, first_pos DESC LIMIT 5)""")
def ngram_extremes(spark, sf):
    return D.ngram_extremes(D.ngram_counts(roles.documents(spark, sf), 2), 5)


def _len_sql(src: str, p: str) -> str:
    return (f"(SELECT avg(len({ws('text')})) AS {p}avg_len, min(len({ws('text')}))::DOUBLE AS {p}min_len, "
            f"max(len({ws('text')}))::DOUBLE AS {p}max_len, avg(len(list_distinct({ws('text')}))) AS {p}avg_unique "
            f"FROM {src})")


@register("length_comparison", f"""
WITH s AS {_len_sql(SYN, 's_')}, r AS {_len_sql(REF, 'r_')}
SELECT metric, round(syn, 6) AS syn, round(ref, 6) AS ref, round(syn - ref, 6) AS diff FROM (
  SELECT 'avg_len' AS metric, s_avg_len AS syn, r_avg_len AS ref FROM s, r UNION ALL
  SELECT 'min_len', s_min_len, r_min_len FROM s, r UNION ALL
  SELECT 'max_len', s_max_len, r_max_len FROM s, r UNION ALL
  SELECT 'avg_unique', s_avg_unique, r_avg_unique FROM s, r)""")
def length_comparison(spark, sf):
    return D.length_comparison(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf))


_SK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
TFIDF = f"""
stf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SK}) AS term FROM {SYN}) GROUP BY ALL),
n1 AS (SELECT count(*) AS n FROM {SYN}),
n2 AS (SELECT count(*) AS n FROM {REF}),
idf AS (SELECT term, ln((1 + any_value(n1.n)) / (1 + count(*))) + 1 AS idf FROM stf, n1 GROUP BY term),
sw AS (SELECT doc_id, term, tf * idf AS w FROM stf JOIN idf USING (term)),
sx AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM sw),
rtf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_SK}) AS term FROM {REF}) GROUP BY ALL),
rw AS (SELECT doc_id, term, tf * idf AS w FROM rtf JOIN idf USING (term)),
rx AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM rw)
"""


def _tfidf(spark, sf):
    return S.tfidf(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf))


@register("tfidf_rows", "WITH " + TFIDF + """
SELECT 'syn' AS corpus, doc_id, term, round(x, 6) AS x FROM sx UNION ALL
SELECT 'ref', doc_id, term, round(x, 6) FROM rx""")
def tfidf_rows(spark, sf):
    x, y, _ = _tfidf(spark, sf)
    return x.withColumn("corpus", F.lit("syn")).unionByName(y.withColumn("corpus", F.lit("ref")))


@register("cosine_mean", "WITH " + TFIDF + """
SELECT round(sum(sx.x * rx.x) / (any_value(n1.n) * any_value(n2.n)), 6) AS cosine
FROM sx JOIN rx USING (term), n1, n2""")
def cosine_mean(spark, sf):
    x, y, _ = _tfidf(spark, sf)
    syn, ref = roles.syn_docs(spark, sf), roles.ref_docs(spark, sf)
    return S.cosine_mean(x, y, syn.agg(F.count("*").alias("n")), ref.agg(F.count("*").alias("n")))


KL_INF = """
k1 AS (SELECT doc_id AS i, count(*) AS k FROM sx GROUP BY doc_id),
pi AS (SELECT sx.doc_id AS i, rx.doc_id AS j, count(*) AS c FROM sx JOIN rx USING (term) GROUP BY ALL),
sub AS (SELECT count(*) AS n_subset FROM pi JOIN k1 USING (i) WHERE c = k),
share AS (SELECT 1 - (n_subset + ((SELECT n FROM n1) - (SELECT count(*) FROM k1)) * (SELECT n FROM n2))
                 / ((SELECT n FROM n1) * (SELECT n FROM n2)) AS s FROM sub)
"""


@register("kl_mean", "WITH " + TFIDF + """
SELECT CASE WHEN (SELECT count(*) FROM rx) < (SELECT count(*) FROM idf) * (SELECT n FROM n2)
            THEN 'Infinity'::DOUBLE
            ELSE round(((SELECT n FROM n2) * (SELECT sum(x * ln(x) - x) FROM sx)
                 - (SELECT sum(sx.x * ln(rx.x)) FROM sx JOIN rx USING (term))
                 + (SELECT n FROM n1) * (SELECT sum(x) FROM rx)) / ((SELECT n FROM n1) * (SELECT n FROM n2)), 6)
       END AS kl, NULL::DOUBLE AS inf_pair_share""")
def kl_mean(spark, sf):
    x, y, idf = _tfidf(spark, sf)
    syn, ref = roles.syn_docs(spark, sf), roles.ref_docs(spark, sf)
    return S.kl_mean(x, y, idf, syn.agg(F.count("*").alias("n")), ref.agg(F.count("*").alias("n")))


# every document as counts of the same three terms: all pairs have a finite divergence
_COUNTED = ("(SELECT doc_id, repeat('alpha ', CAST(1 + n_chars % 4 AS INTEGER)) || repeat('beta ', CAST(1 + doc_id % 5 AS INTEGER)) || repeat('gamma ', "
            "CAST(1 + length(source) % 3 AS INTEGER)) AS text FROM documents WHERE CAST(substr(source, 4) AS INTEGER) {side} 10)")


@register("kl_mean_finite", f"""
WITH s AS (SELECT doc_id, text FROM {_COUNTED.format(side='>=')}), r AS (SELECT doc_id, text FROM {_COUNTED.format(side='<')}),
t AS (SELECT unnest(['alpha', 'beta', 'gamma']) AS term),
sw AS (SELECT doc_id, term, CAST(len(regexp_extract_all(text, term)) AS DOUBLE) AS w FROM s, t),
rw AS (SELECT doc_id, term, CAST(len(regexp_extract_all(text, term)) AS DOUBLE) AS w FROM r, t),
sx AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM sw),
rx AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM rw),
p AS (SELECT sx.doc_id AS i, rx.doc_id AS j, sum(sx.x * ln(sx.x / rx.x) - sx.x + rx.x) AS kl FROM sx JOIN rx USING (term) GROUP BY ALL)
SELECT round(avg(kl), 6) AS kl, CAST(0 AS DOUBLE) AS inf_pair_share FROM p""")
def kl_mean_finite(spark, sf):
    """Every term has idf 1 here (all documents hold all terms), so the twin needs none."""
    times = lambda w, n: F.repeat(F.lit(w), (1 + n).cast("int"))
    docs = roles.documents(spark, sf)
    text = F.concat(times("alpha ", F.col("n_chars") % 4), times("beta ", F.col("doc_id") % 5), times("gamma ", F.length("source") % 3))
    syn, ref = (docs.filter(side).select("doc_id", text.alias("text")) for side in (roles.is_syn(), ~roles.is_syn()))
    x, y, idf = S.tfidf(syn, ref)
    return S.kl_mean(x, y, idf, syn.agg(F.count("*").alias("n")), ref.agg(F.count("*").alias("n")), with_inf_share=True)


@register("kl_inf_share", "WITH " + TFIDF + "," + KL_INF + "SELECT round(s, 6) AS inf_pair_share FROM share")
def kl_inf_share(spark, sf):
    x, y, idf = _tfidf(spark, sf)
    syn, ref = roles.syn_docs(spark, sf), roles.ref_docs(spark, sf)
    return S.kl_mean(x, y, idf, syn.agg(F.count("*").alias("n")), ref.agg(F.count("*").alias("n")),
                     with_inf_share=True).select("inf_pair_share")


JACCARD = f"""
a AS (SELECT doc_id, list_distinct({ws('text')}) AS w FROM {SYN}),
b AS (SELECT doc_id, list_distinct({ws('text')}) AS w FROM {REF}),
pairs AS (SELECT len(list_intersect(a.w, b.w)) AS c, len(a.w) AS ka, len(b.w) AS kb FROM a, b)
"""


@register("jaccard_mean", "WITH " + JACCARD + """
SELECT round(avg(c / (ka + kb - c)), 6) AS jaccard FROM pairs WHERE ka + kb > 0""")
def jaccard_mean(spark, sf):
    return S.jaccard_mean(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf))


@register("compare_corpora", "WITH " + TFIDF + "," + JACCARD + """
SELECT 'cosine' AS metric, round(sum(sx.x * rx.x) / (any_value(n1.n) * any_value(n2.n)), 6) AS value
FROM sx JOIN rx USING (term), n1, n2
UNION ALL
SELECT 'kl_divergence', CASE WHEN (SELECT count(*) FROM rx) < (SELECT count(*) FROM idf) * (SELECT n FROM n2)
  THEN 'Infinity'::DOUBLE ELSE NULL END
UNION ALL
SELECT 'jaccard', round(avg(c / (ka + kb - c)), 6) FROM pairs WHERE ka + kb > 0""")
def compare_corpora(spark, sf):
    return S.compare_corpora(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf))


@register("ngram_counts_treebank", "WITH " + sentences_sql("(SELECT doc_id AS id, text FROM documents)") + f""",
tb AS (SELECT id AS doc_id, flatten(list_transform(s, lambda x: {treebank_sql('lower(x)')})) AS t FROM sents),
tg AS (SELECT doc_id, unnest(range(0, len(t) - 1)) AS pos, unnest(list_transform(range(0, len(t) - 1), lambda i: t[i + 1] || ' ' || t[i + 2])) AS ngram FROM tb),
tc AS (SELECT ngram, count(*) AS cnt, min({{'d': doc_id, 'p': pos}}) AS f FROM tg GROUP BY ngram)
SELECT ngram, cnt, f.d AS first_doc, f.p AS first_pos FROM tc""")
def ngram_counts_treebank(spark, sf):
    """Bigram counts over Treebank tokens of learnt sentences."""
    docs = roles.documents(spark, sf).select("doc_id", "text")
    tokens = SE.treebank_documents(docs, SE.learn_abbreviations(docs))
    return D.ngram_counts(tokens, 2, tokens=F.col("tokens"))
