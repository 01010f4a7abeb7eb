"""Group fairness of classifier predictions.

Performance is computed per subgroup (rows with a NULL subgroup are
dropped); fairness compares the groups: equality differences
``sum_g |rate_g - rate_overall|`` (overall rates from the summed counts),
equalized odds and the max-min spread of F1. Rates with a zero denominator
are NULL and skipped by the sums, maxima and minima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import join_scalars
from .classify import multiclass_metrics, multilabel_metrics


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """TPR, FPR, FNR, TNR with NULL for an empty denominator."""
    return {
        "tpr": F.try_divide(tp, tp + fn), "fpr": F.try_divide(fp, fp + tn),
        "fnr": F.try_divide(fn, fn + tp), "tnr": F.try_divide(tn, tn + fp),
    }


def group_performance(pred: DataFrame, subgroup: str, kind: str = "multilabel", num_classes: int = 2, *,
                      ground: str = "ground", predicted: str = "predicted") -> DataFrame:
    """Per-subgroup metrics: multiclass -> (subgroup, n, accuracy, f1_macro, f1_micro);
    multilabel -> (subgroup, n, precision, recall, f1_micro, f1_macro,
    hamming_loss, subset_accuracy, tn, fp, fn, tp)."""
    p = pred.filter(F.col(subgroup).isNotNull())
    if kind == "multilabel":
        return multilabel_metrics(p, num_classes, ground=ground, predicted=predicted, keys=[subgroup])
    return multiclass_metrics(p, ground=ground, predicted=predicted, keys=[subgroup]).select(
        subgroup, "n", "accuracy", "f1_macro", "f1_micro")


def group_fairness(perf: DataFrame, subgroup: str, kind: str = "multilabel") -> DataFrame:
    """Fairness table from a ``group_performance`` table (one row per group).

    The per-group table has one row per subgroup value; the cross-group
    aggregates are single-row frames joined back on a constant key.
    """
    spread = perf.agg((F.max("f1_micro") - F.min("f1_micro")).alias("f1_micro_diff"),
                      (F.max("f1_macro") - F.min("f1_macro")).alias("f1_macro_diff"))
    if kind != "multilabel":
        return join_scalars(perf.select(subgroup), spread)
    r = rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    per = perf.select(subgroup, *[v.alias(k) for k, v in r.items()])
    tot = perf.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    overall = tot.select(*[v.alias(k + "_all") for k, v in
                           rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).items()])
    j = join_scalars(per, overall)
    eq = j.agg(
        F.sum(F.abs(F.col("fnr") - F.col("fnr_all"))).alias("fned"),
        F.sum(F.abs(F.col("fpr") - F.col("fpr_all"))).alias("fped"),
        F.sum(F.abs(F.col("tpr") - F.col("tpr_all"))).alias("tped"),
        F.sum(F.abs(F.col("tnr") - F.col("tnr_all"))).alias("tned"),
        F.greatest(F.max("tpr") - F.min("tpr"), F.max("fpr") - F.min("fpr")).alias("equalized_odds"),
        F.count_if(F.col("tpr").isNull() | F.col("fpr").isNull() | F.col("fnr").isNull()
                   | F.col("tnr").isNull()).alias("undefined_groups"))
    return join_scalars(per, eq, spread).select(
        subgroup, "fned", "fped", "tped", "tned", "fnr", "tnr", "tpr", "fpr", "equalized_odds",
        "f1_micro_diff", "f1_macro_diff", "undefined_groups")


def analyze_group_fairness(pred: DataFrame, subgroup: str, kind: str = "multilabel",
                           num_classes: int = 2, **kw) -> tuple[DataFrame, DataFrame]:
    """(performance table, fairness table) for any subgroup column."""
    perf = group_performance(pred, subgroup, kind, num_classes, **kw)
    return perf, group_fairness(perf, subgroup, kind)


def tabulate_runs(pred: DataFrame, kind: str = "multiclass", num_classes: int = 2, *,
                  run_col: str = "run_id", subgroup: str | None = None,
                  ground: str = "ground", predicted: str = "predicted") -> DataFrame:
    """One metrics row per run (prediction table keyed by ``run_col``); with
    ``subgroup`` also that run's F1 spreads across subgroups."""
    if kind == "multilabel":
        m = multilabel_metrics(pred, num_classes, ground=ground, predicted=predicted, keys=[run_col])
    else:
        m = multiclass_metrics(pred, ground=ground, predicted=predicted, keys=[run_col])
    if subgroup is None:
        return m
    p = pred.filter(F.col(subgroup).isNotNull())
    if kind == "multilabel":
        g = multilabel_metrics(p, num_classes, ground=ground, predicted=predicted, keys=[run_col, subgroup])
    else:
        g = multiclass_metrics(p, ground=ground, predicted=predicted, keys=[run_col, subgroup])
    spread = g.groupBy(run_col).agg((F.max("f1_micro") - F.min("f1_micro")).alias("f1_micro_diff"),
                                    (F.max("f1_macro") - F.min("f1_macro")).alias("f1_macro_diff"))
    return m.join(spread, run_col, "left")
