"""Label encoding and classifier evaluation (single-label and multilabel).

Metrics are computed from per-class tp/fp/fn counts obtained in one
aggregation; "macro" averages run over the classes seen in ground truth or
predictions (single-label) or over classes 0..k-1 (multilabel), and undefined
ratios count as 0, like scikit-learn's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import join_scalars


# ---------------------------------------------------------------------------
# Label maps


def label_values(df: DataFrame, label_col: str, multilabel: bool = False, sep: str = ",") -> DataFrame:
    """Distinct label strings (multilabel values are split on ``sep``, untrimmed)."""
    c = F.col(label_col).cast("string")
    if multilabel:
        return df.select(F.explode(F.split(c, _literal_regex(sep), -1)).alias("label")).distinct()
    return df.select(c.alias("label")).filter(F.col("label").isNotNull()).distinct()


def _literal_regex(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def save_label_map(label_map: DataFrame, path: str) -> None:
    """Write (label, idx) as JSON lines."""
    label_map.select("label", "idx").write.mode("overwrite").json(path)


def load_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(label, idx) as ``save_label_map`` wrote it."""
    return spark.read.schema("label string, idx int").json(path)


def label_index(df: DataFrame, label_col: str, multilabel: bool = False, sep: str = ",") -> DataFrame:
    """(label, idx): sorted distinct labels numbered 0..k-1 (binary string order).

    The label vocabulary is the set of classes, bounded by construction; the
    numbering window runs over that distinct set only.
    """
    return label_values(df, label_col, multilabel, sep).select(
        "label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("idx"))


def encode_labels(df: DataFrame, label_col: str, label_map: DataFrame, *, multilabel: bool = False,
                  sep: str = ",", out_col: str = "label_idx", id_col: str = "id") -> DataFrame:
    """Map labels through ``label_map`` (label, idx). Single-label: unseen -> NULL.
    Multilabel: list of indices in value order; an unseen label raises."""
    lm = label_map.select(F.col("label").cast("string").alias("_lab"), F.col("idx").alias("_idx"))
    if not multilabel:
        return df.join(lm, F.col(label_col).cast("string") == F.col("_lab"), "left") \
            .drop("_lab").withColumnRenamed("_idx", out_col)
    parts = df.select(id_col, F.posexplode(F.split(F.col(label_col).cast("string"),
                                                   _literal_regex(sep), -1)).alias("_p", "_lab"))
    mapped = parts.join(lm, "_lab", "left").select(
        id_col, "_p", F.when(F.col("_idx").isNull(), F.raise_error(
            F.concat(F.lit("unknown label: "), F.col("_lab")))).otherwise(F.col("_idx")).alias("_idx"))
    lists = mapped.groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_p", "_idx"))), lambda s: s["_idx"]).alias(out_col))
    return df.join(lists, id_col, "left")


def multi_hot(labels: Column, k) -> Column:
    """0/1 vector of width k for an index array."""
    kk = k if isinstance(k, Column) else F.lit(k)
    return F.transform(F.sequence(F.lit(0), kk - 1), lambda i: F.array_contains(labels, i).cast("int"))


def argmax_label(scores: Column) -> Column:
    """0-based index of the largest score (first on ties)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sigmoid_labels(logits: Column, threshold: float = 0.5) -> Column:
    """Indices whose sigmoid(logit) >= threshold."""
    idx = F.sequence(F.lit(0), F.size(logits) - 1)
    return F.filter(idx, lambda i: 1 / (1 + F.exp(-F.element_at(logits, i + 1))) >= threshold)


# ---------------------------------------------------------------------------
# Single-label metrics


def class_counts_single(pred: DataFrame, *, ground: str = "ground", predicted: str = "predicted",
                        keys: list[str] | None = None) -> DataFrame:
    """(keys..., cls, tp, fp, fn) for every class seen as ground or prediction."""
    keys = keys or []
    g, p = F.col(ground), F.col(predicted)
    roles = F.array(
        F.struct(g.alias("cls"), (g == p).cast("int").alias("tp"), F.lit(0).alias("fp"),
                 (g != p).cast("int").alias("fn")),
        F.struct(p.alias("cls"), F.lit(0).alias("tp"), (g != p).cast("int").alias("fp"),
                 F.lit(0).alias("fn")))
    return (pred.select(*keys, F.inline(roles))
            .groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"),
                                       F.sum("fn").alias("fn")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def multiclass_metrics(pred: DataFrame, *, ground: str = "ground", predicted: str = "predicted",
                       keys: list[str] | None = None) -> DataFrame:
    """(keys..., n, accuracy, precision, recall, f1_macro, f1_micro): macro averages
    over the classes seen; micro F1 equals accuracy for single-label data."""
    keys = keys or []
    cc = class_counts_single(pred, ground=ground, predicted=predicted, keys=keys)
    per = cc.select(*keys,
                    _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("p"),
                    _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("r"),
                    _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f"))
    macro = per.groupBy(*keys).agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"),
                                   F.avg("f").alias("f1_macro"))
    acc = pred.groupBy(*keys).agg(F.count("*").alias("n"),
                                  F.avg((F.col(ground) == F.col(predicted)).cast("double")).alias("accuracy"))
    out = acc.join(macro, keys) if keys else join_scalars(acc, macro)
    return out.withColumn("f1_micro", F.col("accuracy"))


# ---------------------------------------------------------------------------
# Multilabel metrics


def parse_label_list(c) -> Column:
    """``"[0, 2]"`` (Python list literal) -> array<int>; arrays pass through."""
    col = F.col(c) if isinstance(c, str) else c
    return F.from_json(col, "array<int>", {"allowSingleQuotes": "true"})


def multilabel_metrics(pred: DataFrame, k: int, *, ground: str = "ground", predicted: str = "predicted",
                       keys: list[str] | None = None) -> DataFrame:
    """(keys..., n, precision, recall, f1_micro, f1_macro, hamming_loss,
    subset_accuracy, tn, fp, fn, tp) over classes 0..k-1 (others ignored).
    Precision/recall are micro averages with the arguments in the right order."""
    keys = keys or []
    rng = F.sequence(F.lit(0), F.lit(k - 1))
    g = F.array_intersect(F.array_distinct(F.col(ground)), rng)
    p = F.array_intersect(F.array_distinct(F.col(predicted)), rng)
    rows = pred.select(*keys, g.alias("_g"), p.alias("_p"))
    per_row = rows.select(
        *keys, "_g", "_p",
        F.size(F.array_intersect("_g", "_p")).alias("_tp"),
        F.size(F.array_except("_p", "_g")).alias("_fp"),
        F.size(F.array_except("_g", "_p")).alias("_fn"))
    totals = per_row.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("_tp").alias("tp"), F.sum("_fp").alias("fp"),
        F.sum("_fn").alias("fn"),
        F.avg((F.array_sort("_g") == F.array_sort("_p")).cast("double")).alias("subset_accuracy"))
    cls = per_row.select(*keys, F.inline(F.transform(
        F.array_union("_g", "_p"),
        lambda c: F.struct(c.alias("cls"),
                           (F.array_contains("_g", c) & F.array_contains("_p", c)).cast("int").alias("tp"),
                           (~F.array_contains("_g", c)).cast("int").alias("fp"),
                           (~F.array_contains("_p", c)).cast("int").alias("fn")))))
    per_cls = cls.groupBy(*keys, "cls").agg(
        _ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("f"))
    macro = per_cls.groupBy(*keys).agg((F.sum("f") / F.lit(k)).alias("f1_macro"))
    out = totals.join(macro, keys, "left") if keys else join_scalars(totals, macro)
    tp, fp, fn, n = F.col("tp"), F.col("fp"), F.col("fn"), F.col("n")
    return out.select(
        *keys, "n",
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_micro"),
        F.coalesce("f1_macro", F.lit(0.0)).alias("f1_macro"),
        ((fp + fn) / (n * F.lit(k))).alias("hamming_loss"), "subset_accuracy",
        (n * F.lit(k) - tp - fp - fn).alias("tn"), fp.alias("fp"), fn.alias("fn"), tp.alias("tp"))


# ---------------------------------------------------------------------------
# X3 / J12


def classification_dataset(df: DataFrame, label_col: str, id_col: str = "id", *, multilabel: bool = False,
                           sep: str = ",", label_map: DataFrame | None = None, train_ratio: float = 0.8,
                           val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42):
    """Encode labels (building the map unless one is given) and assign exact-size
    splits; returns (rows with ``label_idx`` and ``split``, label map)."""
    from .ranking import exact_split
    lm = label_map if label_map is not None else label_index(df, label_col, multilabel, sep)
    enc = encode_labels(df, label_col, lm, multilabel=multilabel, sep=sep, id_col=id_col)
    return exact_split(enc, id_col, train_ratio=train_ratio, val_ratio=val_ratio, test_ratio=test_ratio,
                       seed=seed), lm


def attach_columns(pred: DataFrame, source: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Keep chosen source columns (e.g. subgroups) beside predictions, by id."""
    return pred.join(source.select(id_col, *cols), id_col, "left")
