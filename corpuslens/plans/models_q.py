"""Model-backed queries.

Model fits are seeded but not bit-reproducible across engines, so most of
these are checked on rows only; ROUGE-n has a SQL twin.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as MD
from ..operators import quality as Q
from ..operators import ranking as R
from ..operators import rouge as RG
from . import roles
from .catalog import register


def _labelled(spark, sf):
    docs = roles.documents(spark, sf)
    lab = roles.table(spark, sf, "labels")
    return docs.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "text",
                                           F.col("quality").cast("double").alias("label"),
                                           roles.is_syn().alias("is_syn"))


@register("tstr_classifier")
def tstr_classifier(spark, sf):
    d = _labelled(spark, sf)
    real = R.exact_split(d.filter(~F.col("is_syn")), "id")
    return MD.train_on_synthetic_test_on_real(
        d.filter(F.col("is_syn")).drop("is_syn"),
        real.filter(F.col("split") == "train").drop("is_syn", "split"),
        real.filter(F.col("split") != "train").drop("is_syn", "split"))


@register("silver_labels")
def silver_labels(spark, sf):
    d = _labelled(spark, sf)
    model = MD.train_classifier(d.filter(~F.col("is_syn")))
    docs = roles.syn_docs(spark, sf).join(roles.table(spark, sf, "labels"), "doc_id", "left_anti")
    return MD.silver_labels(model, docs).select("doc_id", "annotated_label")


@register("hashed_embedding_centroid")
def hashed_embedding_centroid(spark, sf):
    emb = MD.hashed_embeddings(roles.documents(spark, sf).select("doc_id", "text", roles.is_syn().alias("s")),
                               dims=16)
    e = emb.select(F.col("doc_id").alias("vec_id"), "embedding", "s")
    return Q.centroid_cosine(e.filter("s"), e.filter(~F.col("s")))[1]


def _pairs(spark, sf):
    c = roles.table(spark, sf, "conversations")
    a, b = c.alias("a"), c.alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select(
        (F.col("a.conv_id") * 1000 + F.col("a.turn")).alias("id"), F.col("a.text").alias("prediction"),
        F.col("b.text").alias("reference"))


_TOK = "list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"


def _rouge_sql(n: int) -> str:
    tp, tr = _TOK.format(x="a.text"), _TOK.format(x="b.text")
    gram = "array_to_string(list_slice(t, i, i + {m}), ' ')".format(m=n - 1)
    return f"""
WITH pr AS (SELECT a.conv_id * 1000 + a.turn AS id, {tp} AS p, {tr} AS r
            FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
gp AS (SELECT id, {gram} AS g, count(*) AS c FROM (SELECT id, p AS t, unnest(range(1, len(p) - {n - 2})) AS i FROM pr)
       GROUP BY ALL),
gr AS (SELECT id, {gram} AS g, count(*) AS c FROM (SELECT id, r AS t, unnest(range(1, len(r) - {n - 2})) AS i FROM pr)
       GROUP BY ALL),
ov AS (SELECT id, sum(least(gp.c, gr.c)) AS ov FROM gp JOIN gr USING (id, g) GROUP BY id),
s AS (SELECT id, greatest(len(p) - {n - 1}, 0) AS np, greatest(len(r) - {n - 1}, 0) AS nr, coalesce(ov, 0) AS ov
      FROM pr LEFT JOIN ov USING (id)),
m AS (SELECT id, CASE WHEN np > 0 THEN ov / np ELSE 0 END AS precision,
             CASE WHEN nr > 0 THEN ov / nr ELSE 0 END AS recall FROM s)
SELECT id, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6)
       AS fmeasure FROM m"""


@register("rouge1", _rouge_sql(1))
def rouge1(spark, sf):
    return RG.rouge_n(_pairs(spark, sf), 1)


@register("rouge2", _rouge_sql(2))
def rouge2(spark, sf):
    return RG.rouge_n(_pairs(spark, sf), 2)


@register("rouge_summary")
def rouge_summary(spark, sf):
    return RG.rouge_summary(_pairs(spark, sf))


@register("quality_report")
def quality_report(spark, sf):
    e = roles.table(spark, sf, "embeddings")
    syn, real = e.filter(F.col("vec_id") % 2 == 0), e.filter(F.col("vec_id") % 2 == 1)
    summ = Q.centroid_cosine(syn, real)[1]
    ppl = Q.corpus_perplexity(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf))
    return MD.quality_report([
        ("run0", "centroid_cosine", "synthetic", summ.filter(F.col("corpus") == "synthetic"), "mean_score"),
        ("run0", "centroid_cosine", "real", summ.filter(F.col("corpus") == "real"), "mean_score"),
        ("run0", "perplexity", "synthetic", ppl.filter(F.col("corpus") == "synthetic"), "mean_perplexity"),
        ("run0", "perplexity", "real", ppl.filter(F.col("corpus") == "real"), "mean_perplexity"),
    ])
