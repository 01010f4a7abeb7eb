"""Coreference queries (X8, X9, S5, A34-A40) on conversations: document =
conversation, mention = turn, gold cluster = role, predicted cluster =
length(text) mod 3."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coref as CO
from . import roles
from ..functions.treebank import treebank_sql
from .catalog import register, sentences_sql

BASE = """
gold AS (SELECT conv_id AS doc_key, role AS cluster, turn AS start, turn AS "end" FROM conversations),
pred AS (SELECT conv_id AS doc_key, CAST(length(text) % 3 AS VARCHAR) AS cluster, turn AS start, turn AS "end"
         FROM conversations)
"""


def _muc(side: str, other: str, p: str) -> str:
    return f"""
{p}mm AS (SELECT doc_key, start, "end", max(cluster) AS other FROM {other} GROUP BY ALL),
{p}per AS (SELECT s.doc_key, s.cluster, count(*) AS size, count(*) FILTER (WHERE m.other IS NULL) AS missing,
                  count(DISTINCT m.other) AS linked
           FROM {side} s LEFT JOIN {p}mm m USING (doc_key, start, "end") GROUP BY ALL),
{p}res AS (SELECT CAST(sum(size - missing - linked) AS DOUBLE) AS num, CAST(sum(size - 1) AS DOUBLE) AS den FROM {p}per)
"""


def _b3(side: str, other: str, p: str) -> str:
    return f"""
{p}mm AS (SELECT doc_key, start, "end", max(cluster) AS other FROM {other} GROUP BY ALL),
{p}osz AS (SELECT doc_key, cluster AS other, count(*) AS osize FROM {other} GROUP BY ALL),
{p}sz AS (SELECT doc_key, cluster, count(*) AS size FROM {side} GROUP BY ALL),
{p}cnt AS (SELECT s.doc_key, s.cluster, z.size, m.other, count(*) AS cnt
           FROM {side} s JOIN {p}sz z USING (doc_key, cluster)
           JOIN {p}mm m USING (doc_key, start, "end") JOIN {p}osz o USING (doc_key, other)
           WHERE z.size > 1 AND o.osize <> 1 GROUP BY ALL),
{p}res AS (SELECT coalesce((SELECT sum(c / size) FROM (SELECT doc_key, cluster, size, sum(cnt * cnt) AS c
                                                      FROM {p}cnt GROUP BY ALL)), 0) AS num,
                  coalesce((SELECT CAST(sum(size) AS DOUBLE) FROM {p}sz WHERE size > 1), 0) AS den)
"""


def _lea(side: str, other: str, p: str) -> str:
    return f"""
{p}mm AS (SELECT doc_key, start, "end", max(cluster) AS other FROM {other} GROUP BY ALL),
{p}sz AS (SELECT doc_key, cluster, count(*) AS size FROM {side} GROUP BY ALL),
{p}cnt AS (SELECT s.doc_key, s.cluster, z.size, m.other, count(*) AS cnt
           FROM {side} s JOIN {p}sz z USING (doc_key, cluster) JOIN {p}mm m USING (doc_key, start, "end")
           WHERE z.size > 1 GROUP BY ALL),
{p}res AS (SELECT coalesce((SELECT sum(size * common / (size * (size - 1) / 2)) FROM
                   (SELECT doc_key, cluster, size, sum(cnt * (cnt - 1) / 2) AS common FROM {p}cnt GROUP BY ALL)), 0) AS num,
                  coalesce((SELECT CAST(sum(size) AS DOUBLE) FROM {p}sz WHERE size > 1), 0) AS den)
"""


def _prf_sql(metric: str, digits: int = 6) -> str:
    pp = "CASE WHEN p.den = 0 THEN 0 ELSE p.num / p.den END"
    rr = "CASE WHEN r.den = 0 THEN 0 ELSE r.num / r.den END"
    return f"""SELECT '{metric}' AS metric,
  round(CASE WHEN p.num = 0 THEN 0 ELSE p.num / p.den END, {digits}) AS precision,
  round(CASE WHEN r.num = 0 THEN 0 ELSE r.num / r.den END, {digits}) AS recall,
  round(CASE WHEN {pp} + {rr} = 0 THEN 0 ELSE 2 * {pp} * {rr} / ({pp} + {rr}) END, {digits}) AS f1
FROM p_res p, r_res r"""


_CLUSTERS = 4  # clusters of a conversation that the assignment below tries out (roles: 3, lengths: 3)


def _ceafe(pred: str, gold: str) -> str:
    """The best one-to-one assignment by trying all: each predicted cluster of a
    document takes a gold cluster or none, no gold cluster twice."""
    tries = range(1, _CLUSTERS + 1)
    apart = " AND ".join(f"(o{a}.gold IS NULL OR o{b}.gold IS NULL OR o{a}.gold <> o{b}.gold)" for a in tries for b in tries if a < b)
    options = ",".join(f"""
o{k} AS (SELECT doc_key, gold, phi AS v FROM phi WHERE k = {k} UNION ALL SELECT doc_key, NULL, 0 FROM docs)""" for k in tries)
    return f"""
psz AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY cluster) AS k FROM (
          SELECT doc_key, cluster, count(*) AS size FROM {pred} GROUP BY ALL HAVING count(*) <> 1)),
gsz AS (SELECT doc_key, cluster, count(*) AS size FROM {gold} GROUP BY ALL),
docs AS (SELECT DISTINCT doc_key FROM {gold}),
phi AS (SELECT g.doc_key, g.cluster AS gold, psz.k, 2.0 * count(*) / (any_value(gsz.size) + any_value(psz.size)) AS phi
        FROM {gold} g JOIN {pred} p USING (doc_key, start, "end") JOIN psz ON psz.doc_key = p.doc_key AND psz.cluster = p.cluster
        JOIN gsz ON gsz.doc_key = g.doc_key AND gsz.cluster = g.cluster GROUP BY g.doc_key, g.cluster, psz.k),{options},
best AS (SELECT o1.doc_key, max({" + ".join(f"o{k}.v" for k in tries)}) AS sim
         FROM o1 {" ".join(f"JOIN o{k} USING (doc_key)" for k in tries if k > 1)} WHERE {apart} GROUP BY o1.doc_key),
p_res AS (SELECT (SELECT CAST(coalesce(sum(sim), 0) AS DOUBLE) FROM best) AS num, CAST(count(*) AS DOUBLE) AS den FROM psz),
r_res AS (SELECT (SELECT CAST(coalesce(sum(sim), 0) AS DOUBLE) FROM best) AS num, CAST(count(*) AS DOUBLE) AS den FROM gsz)
"""


def _scores(pred: str, gold: str, with_lea: bool) -> str:
    """All metrics' rows and the mean of MUC, B-cubed and CEAF-e, unrounded."""
    one = lambda metric, ctes: f"SELECT * FROM (WITH {ctes} {_prf_sql(metric, 15)})"
    two = lambda f: f(pred, gold, "p_") + "," + f(gold, pred, "r_")
    main = [one("muc", two(_muc)), one("b_cubed", two(_b3)), one("ceafe", _ceafe(pred, gold))]
    mean = f"SELECT 'avg' AS metric, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM ({' UNION ALL '.join(main)})"
    return " UNION ALL ".join([*main, mean, *([one("lea", two(_lea))] if with_lea else [])])


_ROUNDED = "SELECT metric, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({})"


def _gp(spark, sf):
    return roles.coref_pred(spark, sf), roles.coref_gold(spark, sf)


def _one(name, fn, pred, gold):
    from ..session import join_scalars
    pc = fn(pred, gold).select(F.col("num").alias("p_num"), F.col("den").alias("p_den"))
    rc = fn(gold, pred).select(F.col("num").alias("r_num"), F.col("den").alias("r_den"))
    p, r, f = CO._prf(F.col("p_num"), F.col("p_den"), F.col("r_num"), F.col("r_den"))
    return join_scalars(pc, rc).select(F.lit(name).alias("metric"), p.alias("precision"),
                                       r.alias("recall"), f.alias("f1"))


@register("coref_muc", "WITH " + BASE + "," + _muc("pred", "gold", "p_") + "," + _muc("gold", "pred", "r_")
          + _prf_sql("muc"))
def coref_muc(spark, sf):
    return _one("muc", CO.muc_counts, *_gp(spark, sf))


@register("coref_b_cubed", "WITH " + BASE + "," + _b3("pred", "gold", "p_") + "," + _b3("gold", "pred", "r_")
          + _prf_sql("b_cubed"))
def coref_b_cubed(spark, sf):
    return _one("b_cubed", CO.b_cubed_counts, *_gp(spark, sf))


@register("coref_lea", "WITH " + BASE + "," + _lea("pred", "gold", "p_") + "," + _lea("gold", "pred", "r_")
          + _prf_sql("lea"))
def coref_lea(spark, sf):
    return _one("lea", CO.lea_counts, *_gp(spark, sf))


@register("coref_scores", "WITH " + BASE + _ROUNDED.format(_scores("pred", "gold", True)))
def coref_scores(spark, sf):
    return CO.coref_scores(*_gp(spark, sf), with_lea=True)


@register("coref_identity", "WITH " + BASE + _ROUNDED.format(_scores("gold", "gold", True)))
def coref_identity(spark, sf):
    """Gold scored against itself: MUC, B3, LEA are 1 when no singleton clusters."""
    g = roles.coref_gold(spark, sf)
    return CO.coref_scores(g, g, with_lea=True)


@register("coref_mentions", "WITH " + BASE + """,
p AS (SELECT DISTINCT doc_key, start, "end" FROM pred), g AS (SELECT DISTINCT doc_key, start, "end" FROM gold),
c AS (SELECT count(*) FILTER (WHERE p.doc_key IS NOT NULL AND g.doc_key IS NOT NULL) AS tp,
             count(*) FILTER (WHERE g.doc_key IS NULL) AS fp, count(*) FILTER (WHERE p.doc_key IS NULL) AS fn
      FROM p FULL OUTER JOIN g USING (doc_key, start, "end"))
SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0 END, 6) AS f1
FROM c""")
def coref_mentions(spark, sf):
    return CO.mention_prf(*_gp(spark, sf))


@register("coref_mention_map", "WITH " + BASE + """
SELECT doc_key, start, "end", max(cluster) AS other FROM pred GROUP BY ALL""")
def coref_mention_map(spark, sf):
    return CO.mention_map(roles.coref_pred(spark, sf))


@register("coref_metric_diff", "WITH " + BASE + f""",
pred2 AS (SELECT conv_id AS doc_key, CAST(length(text) % 2 AS VARCHAR) AS cluster, turn AS start, turn AS "end" FROM conversations),
a AS ({_scores("pred", "gold", False)}), b AS ({_scores("pred2", "gold", False)})
SELECT metric, round(b.precision - a.precision, 6) AS precision_diff, round(b.recall - a.recall, 6) AS recall_diff,
       round(b.f1 - a.f1, 6) AS f1_diff FROM a JOIN b USING (metric)""")
def coref_metric_diff(spark, sf):
    c = roles.table(spark, sf, "conversations")
    gold = roles.coref_gold(spark, sf)
    pred2 = c.select(F.col("conv_id").alias("doc_key"), (F.length("text") % 2).cast("string").alias("cluster"),
                     F.col("turn").alias("start"), F.col("turn").alias("end"))
    return CO.metric_diff(CO.coref_scores(roles.coref_pred(spark, sf), gold),
                          CO.coref_scores(pred2, gold))


def _links(spark, sf):
    c = roles.table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return c.select(F.col("conv_id").alias("doc_key"), F.col("turn").alias("mention"),
                    F.lag("turn").over(w).alias("antecedent")).filter(F.col("antecedent").isNotNull())


@register("coref_link_clusters", """
SELECT conv_id AS doc_key, turn AS mention, min(turn) OVER (PARTITION BY conv_id, role) AS root
FROM conversations QUALIFY count(*) OVER (PARTITION BY conv_id, role) >= 2""")
def coref_link_clusters(spark, sf):
    return CO.clusters_from_links(_links(spark, sf))


@register("coref_doc_stats", """
SELECT CAST(coalesce(max(n), -1) AS BIGINT) AS max_mentions, CAST(coalesce(max(mx), -1) AS BIGINT) AS max_cluster_size,
       CAST(coalesce(max(k), -1) AS BIGINT) AS max_clusters
FROM (SELECT conv_id, sum(c) AS n, max(c) AS mx, count(*) AS k
      FROM (SELECT conv_id, role, count(*) AS c FROM conversations GROUP BY ALL) GROUP BY conv_id)""")
def coref_doc_stats(spark, sf):
    c = roles.table(spark, sf, "conversations")
    per_role = c.groupBy("conv_id", "role").agg(
        F.array_sort(F.collect_list(F.array("turn", "turn"))).alias("cluster"))
    docs = per_role.groupBy("conv_id").agg(F.collect_list("cluster").alias("clusters"))
    return CO.doc_stats(docs)


@register("coref_attach_clusters", """
WITH p AS (SELECT conv_id AS doc_key, CAST(length(text) % 3 AS VARCHAR) AS cluster, turn FROM conversations
           WHERE conv_id % 4 <> 0),
pc AS (SELECT doc_key, count(DISTINCT cluster) AS n_clusters, count(*) AS n_mentions FROM p GROUP BY doc_key),
d AS (SELECT DISTINCT conv_id AS doc_key FROM conversations)
SELECT d.doc_key, coalesce(n_clusters, 0) AS n_clusters, coalesce(n_mentions, 0) AS n_mentions
FROM d LEFT JOIN pc USING (doc_key)""")
def coref_attach_clusters(spark, sf):
    c = roles.table(spark, sf, "conversations")
    pred = roles.coref_pred(spark, sf).filter(F.col("doc_key") % 4 != 0)
    docs = c.select(F.col("conv_id").alias("doc_key")).distinct()
    out = CO.attach_clusters(docs, CO.nest_clusters(pred))
    return out.select("doc_key", F.size("clusters").alias("n_clusters"),
                      F.size(F.flatten("clusters")).alias("n_mentions"))


@register("coref_sentences", "WITH " + sentences_sql("(SELECT conv_id * 1000 + turn AS id, text FROM conversations)") + f"""
SELECT CAST(id AS VARCHAR) AS doc_key, len(s) AS n_sentences, len(flatten(list_transform(s, lambda x: {treebank_sql('x')}))) AS n_tokens FROM sents""")
def coref_sentences(spark, sf):
    c = roles.table(spark, sf, "conversations")
    return CO.sentences(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_key"), "text")).select(
        "doc_key", F.size("sentences").alias("n_sentences"), F.size(F.flatten("sentences")).alias("n_tokens"))
