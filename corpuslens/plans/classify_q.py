"""Label encoding, splits, classifier metrics and fairness queries
(X2, X3, J7, K4-K8, F12, F13, A18-A26)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators import fairness as FA
from ..operators import ranking as R
from . import roles
from .catalog import register

PRED1 = """(SELECT l.doc_id AS id, l.quality AS ground, CAST(d.n_chars > 1500 AS INTEGER) AS predicted,
                   d.lang AS subgroup FROM labels l JOIN documents d USING (doc_id))"""
PREDM = """(SELECT l.doc_id AS id,
   list_filter([CASE WHEN l.quality = 1 THEN 0 END, CASE WHEN l.toxic = 1 THEN 1 END], lambda x: x IS NOT NULL) AS ground,
   list_filter([CASE WHEN d.n_chars > 1500 THEN 0 END, CASE WHEN d.n_chars % 3 = 0 THEN 1 END,
                CASE WHEN d.n_chars < 300 THEN 2 END], lambda x: x IS NOT NULL) AS predicted,
   d.lang AS subgroup FROM labels l JOIN documents d USING (doc_id))"""


def _r(x: str) -> str:
    return f"round({x}, 6)"


def multiclass_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    grp = f"GROUP BY {k}" if keys else ""
    join = f"JOIN macro USING ({k})" if keys else ", macro"
    return f"""
p AS (SELECT * FROM {src}),
rl AS (SELECT {kc}ground AS cls, CAST(ground = predicted AS INT) AS tp, 0 AS fp,
              CAST(ground <> predicted AS INT) AS fn FROM p
       UNION ALL SELECT {kc}predicted, 0, CAST(ground <> predicted AS INT), 0 FROM p),
cc AS (SELECT {kc}cls, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM rl GROUP BY {kc}cls),
per AS (SELECT {kc}CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
               CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc,
               CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM cc),
macro AS (SELECT {kc}avg(pr) AS precision, avg(rc) AS recall, avg(f) AS f1_macro FROM per {grp}),
acc AS (SELECT {kc}count(*) AS n, avg(CAST(ground = predicted AS DOUBLE)) AS accuracy FROM p {grp}),
mc AS (SELECT {kc}n, accuracy, precision, recall, f1_macro, accuracy AS f1_micro FROM acc {join})
"""


def multilabel_sql(src: str, keys: list[str], k: int) -> str:
    kk = ", ".join(keys)
    kc = (kk + ", ") if keys else ""
    grp = f"GROUP BY {kk}" if keys else ""
    join = f"LEFT JOIN macro USING ({kk})" if keys else ", macro"
    return f"""
p AS (SELECT {kc}list_intersect(list_distinct(ground), range(0, {k})) AS g,
             list_intersect(list_distinct(predicted), range(0, {k})) AS q FROM {src}),
pr AS (SELECT {kc}g, q, len(list_intersect(g, q)) AS tp,
              len(list_filter(q, lambda x: NOT list_contains(g, x))) AS fp,
              len(list_filter(g, lambda x: NOT list_contains(q, x))) AS fn FROM p),
tot AS (SELECT {kc}count(*) AS n, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn,
               avg(CAST(list_sort(g) = list_sort(q) AS DOUBLE)) AS subset_accuracy FROM pr {grp}),
cl AS (SELECT {kc}c AS cls, CAST(list_contains(g, c) AND list_contains(q, c) AS INT) AS tp,
              CAST(NOT list_contains(g, c) AS INT) AS fp, CAST(NOT list_contains(q, c) AS INT) AS fn
       FROM (SELECT {kc}g, q, unnest(list_distinct(list_concat(g, q))) AS c FROM pr)),
pc AS (SELECT {kc}cls, CASE WHEN 2 * sum(tp) + sum(fp) + sum(fn) > 0
              THEN 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) ELSE 0 END AS f FROM cl GROUP BY {kc}cls),
macro AS (SELECT {kc}sum(f) / {k} AS f1_macro FROM pc {grp}),
ml AS (SELECT {kc}n,
   CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
   CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
   CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1_micro,
   coalesce(f1_macro, 0) AS f1_macro, (fp + fn) / (n * {k}) AS hamming_loss, subset_accuracy,
   CAST(n * {k} - tp - fp - fn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
   CAST(tp AS BIGINT) AS tp
   FROM tot {join})
"""


def _sel(cols: str) -> str:
    return ", ".join(_r(c) + f" AS {c}" if c not in ("n", "subgroup", "run_id", "tn", "fp", "fn", "tp") else c
                     for c in [c.strip() for c in cols.split(",")])


# ---------------------------------------------------------------------------


@register("label_map", """SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
FROM (SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL)""")
def label_map(spark, sf):
    return C.label_index(roles.documents(spark, sf), "lang")


_MULTI = "(SELECT doc_id AS id, lang || ',' || source AS labs FROM documents)"


@register("label_map_multi", f"""SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
FROM (SELECT DISTINCT unnest(string_split(labs, ',')) AS label FROM {_MULTI})""")
def label_map_multi(spark, sf):
    d = roles.documents(spark, sf).select(F.concat_ws(",", "lang", "source").alias("labs"))
    return C.label_index(d, "labs", multilabel=True)


@register("encode_labels", """
WITH m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
           FROM (SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL))
SELECT d.doc_id, d.lang, m.idx AS label_idx FROM documents d LEFT JOIN m ON d.lang = m.label""")
def encode_labels(spark, sf):
    d = roles.documents(spark, sf).select("doc_id", "lang")
    return C.encode_labels(d, "lang", C.label_index(d, "lang"))


@register("encode_labels_multi", f"""
WITH m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
           FROM (SELECT DISTINCT unnest(string_split(labs, ',')) AS label FROM {_MULTI})),
e AS (SELECT id, unnest(range(0, len(string_split(labs, ',')))) AS pos, unnest(string_split(labs, ',')) AS label
      FROM {_MULTI})
SELECT id, array_to_string(list(idx ORDER BY pos), ',') AS label_idx FROM e JOIN m USING (label) GROUP BY id""")
def encode_labels_multi(spark, sf):
    d = roles.documents(spark, sf).select(F.col("doc_id").alias("id"),
                                          F.concat_ws(",", "lang", "source").alias("labs"))
    out = C.encode_labels(d, "labs", C.label_index(d, "labs", multilabel=True), multilabel=True)
    return out.select("id", F.array_join("label_idx", ",").alias("label_idx"))


_SPLIT = """(SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS r,
                    count(*) OVER () AS n FROM documents)"""
_SIZES = "ceil(n * 0.2)"


@register("exact_split", f"""
SELECT doc_id, CASE WHEN r <= ceil({_SIZES} * 0.5) THEN 'test'
                    WHEN r <= {_SIZES} THEN 'validation' ELSE 'train' END AS split
FROM {_SPLIT}""")
def exact_split(spark, sf):
    return R.exact_split(roles.documents(spark, sf).select("doc_id"), "doc_id")


@register("split_sizes", f"""
SELECT split, count(*) AS n FROM (
SELECT CASE WHEN r <= ceil({_SIZES} * 0.5) THEN 'test'
            WHEN r <= {_SIZES} THEN 'validation' ELSE 'train' END AS split FROM {_SPLIT}) GROUP BY split""")
def split_sizes(spark, sf):
    return R.exact_split(roles.documents(spark, sf).select("doc_id"), "doc_id").groupBy("split") \
        .agg(F.count("*").alias("n"))


@register("nested_split", """
SELECT doc_id, CASE WHEN r <= round(round(n * 0.9) * 0.95) THEN 'train'
                    WHEN r <= round(n * 0.9) THEN 'eval' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR))) AS r,
             count(*) OVER () AS n FROM labels)""")
def nested_split(spark, sf):
    return R.nested_split(roles.table(spark, sf, "labels").select("doc_id"), "doc_id")


@register("seeded_sample", """
SELECT doc_id, source FROM documents ORDER BY md5('0:' || CAST(doc_id AS VARCHAR)) LIMIT 100""")
def seeded_sample(spark, sf):
    return R.seeded_sample(roles.documents(spark, sf).select("doc_id", "source"), "doc_id", 100, seed=0)


@register("multiclass_metrics", "WITH " + multiclass_sql(PRED1, []) +
          f"SELECT {_sel('n, accuracy, precision, recall, f1_macro, f1_micro')} FROM mc")
def multiclass_metrics(spark, sf):
    return C.multiclass_metrics(roles.single_label_predictions(spark, sf))


@register("multilabel_metrics", "WITH " + multilabel_sql(PREDM, [], 3) +
          f"SELECT {_sel('n, precision, recall, f1_micro, f1_macro, hamming_loss, subset_accuracy, tn, fp, fn, tp')} FROM ml")
def multilabel_metrics(spark, sf):
    return C.multilabel_metrics(roles.multilabel_predictions(spark, sf), 3)


@register("group_perf_multiclass", "WITH " + multiclass_sql(
    f"(SELECT * FROM {PRED1} WHERE subgroup IS NOT NULL)", ["subgroup"]) +
    f"SELECT {_sel('subgroup, n, accuracy, f1_macro, f1_micro')} FROM mc")
def group_perf_multiclass(spark, sf):
    return FA.group_performance(roles.single_label_predictions(spark, sf), "subgroup", "multiclass")


_ML_GROUP = multilabel_sql(f"(SELECT * FROM {PREDM} WHERE subgroup IS NOT NULL)", ["subgroup"], 3)


@register("group_perf_multilabel", "WITH " + _ML_GROUP +
          f"SELECT {_sel('subgroup, n, precision, recall, f1_micro, f1_macro, hamming_loss, subset_accuracy, tn, fp, fn, tp')} FROM ml")
def group_perf_multilabel(spark, sf):
    return FA.group_performance(roles.multilabel_predictions(spark, sf), "subgroup", "multilabel", 3)


def _rate(a, b):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END"


@register("fairness_multilabel", "WITH " + _ML_GROUP + f""",
per AS (SELECT subgroup, {_rate('tp', 'tp + fn')} AS tpr, {_rate('fp', 'fp + tn')} AS fpr,
               {_rate('fn', 'fn + tp')} AS fnr, {_rate('tn', 'tn + fp')} AS tnr, f1_micro, f1_macro FROM ml),
t AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM ml),
o AS (SELECT {_rate('tp', 'tp + fn')} AS tpr_all, {_rate('fp', 'fp + tn')} AS fpr_all,
             {_rate('fn', 'fn + tp')} AS fnr_all, {_rate('tn', 'tn + fp')} AS tnr_all FROM t),
eq AS (SELECT sum(abs(fnr - fnr_all)) AS fned, sum(abs(fpr - fpr_all)) AS fped, sum(abs(tpr - tpr_all)) AS tped,
              sum(abs(tnr - tnr_all)) AS tned, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS equalized_odds,
              count(*) FILTER (WHERE tpr IS NULL OR fpr IS NULL OR fnr IS NULL OR tnr IS NULL) AS undefined_groups,
              max(f1_micro) - min(f1_micro) AS f1_micro_diff, max(f1_macro) - min(f1_macro) AS f1_macro_diff
       FROM per, o)
SELECT subgroup, {_sel('fned, fped, tped, tned, fnr, tnr, tpr, fpr, equalized_odds, f1_micro_diff, f1_macro_diff')},
       undefined_groups FROM per, eq""")
def fairness_multilabel(spark, sf):
    perf = FA.group_performance(roles.multilabel_predictions(spark, sf), "subgroup", "multilabel", 3)
    return FA.group_fairness(perf, "subgroup", "multilabel")


@register("fairness_multiclass", "WITH " + multiclass_sql(
    f"(SELECT * FROM {PRED1} WHERE subgroup IS NOT NULL)", ["subgroup"]) + f"""
SELECT subgroup, {_r('max(f1_micro) OVER () - min(f1_micro) OVER ()')} AS f1_micro_diff,
       {_r('max(f1_macro) OVER () - min(f1_macro) OVER ()')} AS f1_macro_diff FROM mc""")
def fairness_multiclass(spark, sf):
    perf = FA.group_performance(roles.single_label_predictions(spark, sf), "subgroup", "multiclass")
    return FA.group_fairness(perf, "subgroup", "multiclass")


_RUNS = """(SELECT 'long1500' AS run_id, l.quality AS ground, CAST(d.n_chars > 1500 AS INTEGER) AS predicted, d.lang AS subgroup
            FROM labels l JOIN documents d USING (doc_id)
            UNION ALL
            SELECT 'long800', l.quality, CAST(d.n_chars > 800 AS INTEGER), d.lang
            FROM labels l JOIN documents d USING (doc_id))"""


@register("tabulate_runs", "WITH " + multiclass_sql(_RUNS, ["run_id"]) +
          f"SELECT {_sel('run_id, n, accuracy, precision, recall, f1_macro, f1_micro')} FROM mc")
def tabulate_runs(spark, sf):
    lab = roles.table(spark, sf, "labels")
    docs = roles.documents(spark, sf)
    j = lab.join(docs, "doc_id")
    runs = j.select(F.lit("long1500").alias("run_id"), F.col("quality").alias("ground"),
                    (F.col("n_chars") > 1500).cast("int").alias("predicted"), F.col("lang").alias("subgroup")) \
        .unionByName(j.select(F.lit("long800").alias("run_id"), F.col("quality").alias("ground"),
                              (F.col("n_chars") > 800).cast("int").alias("predicted"),
                              F.col("lang").alias("subgroup")))
    return FA.tabulate_runs(runs, "multiclass")


@register("multi_hot", f"""
WITH p AS (SELECT * FROM {PREDM}), k AS (SELECT max(list_max(ground)) + 1 AS k FROM p)
SELECT id, array_to_string(list_transform(range(0, k), lambda i: CAST(list_contains(ground, i) AS INT)), '') AS bits
FROM p, k""")
def multi_hot(spark, sf):
    p = roles.multilabel_predictions(spark, sf)
    k = p.agg((F.max(F.array_max("ground")) + 1).alias("_k"))
    from ..session import join_scalars
    return join_scalars(p, k).select("id", F.array_join(C.multi_hot(F.col("ground"), F.col("_k")), "").alias("bits"))


@register("argmax_labels", """
SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS predicted,
       array_to_string(list_filter(range(0, len(embedding)), lambda i: 1 / (1 + exp(-embedding[i + 1])) >= 0.5), ',') AS multi
FROM embeddings""")
def argmax_labels(spark, sf):
    e = roles.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select("vec_id", C.argmax_label(F.col("v")).alias("predicted"),
                    F.array_join(C.sigmoid_labels(F.col("v")), ",").alias("multi"))


@register("classification_dataset", f"""
WITH m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx
           FROM (SELECT DISTINCT lang AS label FROM documents WHERE lang IS NOT NULL)),
e AS (SELECT d.doc_id AS id, m.idx AS label_idx FROM documents d LEFT JOIN m ON d.lang = m.label),
r AS (SELECT id, label_idx, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS r,
             count(*) OVER () AS n FROM e)
SELECT id, label_idx, CASE WHEN r <= ceil(ceil(n * 0.2) * 0.5) THEN 'test'
                           WHEN r <= ceil(n * 0.2) THEN 'validation' ELSE 'train' END AS split FROM r""")
def classification_dataset(spark, sf):
    d = roles.documents(spark, sf).select(F.col("doc_id").alias("id"), "lang")
    out, _ = C.classification_dataset(d, "lang", "id")
    return out.select("id", "label_idx", "split")


@register("predictions_with_subgroups", f"""
SELECT p.id, CAST(p.ground AS BIGINT) AS ground, CAST(p.predicted AS BIGINT) AS predicted, d.lang, d.source
FROM {PRED1} p LEFT JOIN documents d ON p.id = d.doc_id""")
def predictions_with_subgroups(spark, sf):
    p = roles.single_label_predictions(spark, sf).drop("subgroup")
    src = roles.documents(spark, sf).select(F.col("doc_id").alias("id"), "lang", "source")
    return C.attach_columns(p, src, "id", ["lang", "source"])
