import numpy as np
from pyspark.sql import functions as F

from corpuslens.operators import classify as C
from corpuslens.operators import fairness as FA


def _f1(tp, fp, fn):
    d = 2 * tp + fp + fn
    return 0.0 if d == 0 else 2 * tp / d


def _single(rows):
    g = np.array([r[1] for r in rows])
    p = np.array([r[2] for r in rows])
    classes = sorted(set(g) | set(p))
    f = [_f1(((g == c) & (p == c)).sum(), ((g != c) & (p == c)).sum(), ((g == c) & (p != c)).sum()) for c in classes]
    return float((g == p).mean()), float(np.mean(f))


def test_single_label_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2)), "abc"[i % 3]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ground int, predicted int, subgroup string")
    perf = {r.subgroup: r for r in FA.group_performance(df, "subgroup", "multiclass").collect()}
    for s in "abc":
        acc, f1m = _single([r for r in rows if r[3] == s])
        assert abs(perf[s].accuracy - acc) < 1e-12 and abs(perf[s].f1_macro - f1m) < 1e-12
        assert perf[s].f1_micro == perf[s].accuracy
    fair = FA.group_fairness(FA.group_performance(df, "subgroup", "multiclass"), "subgroup", "multiclass").collect()
    spread = max(p.f1_macro for p in perf.values()) - min(p.f1_macro for p in perf.values())
    assert all(abs(r.f1_macro_diff - spread) < 1e-12 for r in fair)


def test_multilabel_metrics_and_rates(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(100):
        g = sorted(set(int(x) for x in rng.integers(0, 3, size=int(rng.integers(1, 4)))))
        p = sorted(set(int(x) for x in rng.integers(0, 3, size=int(rng.integers(1, 4)))))
        rows.append((i, g, p, "xy"[i % 2]))
    df = spark.createDataFrame(rows, "id long, ground array<int>, predicted array<int>, subgroup string")
    perf = {r.subgroup: r for r in FA.group_performance(df, "subgroup", "multilabel", 3).collect()}
    tot = {"tp": 0, "fp": 0, "fn": 0, "tn": 0}
    rates = {}
    for s in "xy":
        sub = [r for r in rows if r[3] == s]
        G = np.array([[int(c in r[1]) for c in range(3)] for r in sub])
        P = np.array([[int(c in r[2]) for c in range(3)] for r in sub])
        tp, fp, fn = int((G & P).sum()), int(((1 - G) & P).sum()), int((G & (1 - P)).sum())
        tn = G.size - tp - fp - fn
        assert (perf[s].tp, perf[s].fp, perf[s].fn, perf[s].tn) == (tp, fp, fn, tn)
        assert abs(perf[s].precision - tp / (tp + fp)) < 1e-12
        assert abs(perf[s].recall - tp / (tp + fn)) < 1e-12
        f1s = [_f1(int((G[:, c] & P[:, c]).sum()), int(((1 - G[:, c]) & P[:, c]).sum()),
                   int((G[:, c] & (1 - P[:, c])).sum())) for c in range(3)]
        assert abs(perf[s].f1_macro - np.mean(f1s)) < 1e-12
        assert abs(perf[s].hamming_loss - (fp + fn) / G.size) < 1e-12
        assert abs(perf[s].subset_accuracy - np.mean([(G[i] == P[i]).all() for i in range(len(sub))])) < 1e-12
        for k, v in zip(("tp", "fp", "fn", "tn"), (tp, fp, fn, tn)):
            tot[k] += v
        rates[s] = (tp / (tp + fn), fp / (fp + tn))
    fair = {r.subgroup: r for r in FA.group_fairness(
        FA.group_performance(df, "subgroup", "multilabel", 3), "subgroup").collect()}
    tpr_all = tot["tp"] / (tot["tp"] + tot["fn"])
    exp_tped = sum(abs(rates[s][0] - tpr_all) for s in "xy")
    assert all(abs(r.tped - exp_tped) < 1e-12 for r in fair.values())
    eo = max(max(r[0] for r in rates.values()) - min(r[0] for r in rates.values()),
             max(r[1] for r in rates.values()) - min(r[1] for r in rates.values()))
    assert all(abs(r.equalized_odds - eo) < 1e-12 for r in fair.values())


def test_identical_groups_are_fair(spark):
    rows = [(i, i % 2, (i // 2) % 2, g) for g in "ab" for i in range(20)]
    df = spark.createDataFrame(rows, "id long, ground int, predicted int, subgroup string")
    for r in FA.group_fairness(FA.group_performance(df, "subgroup", "multiclass"), "subgroup", "multiclass").collect():
        assert r.f1_macro_diff == 0 and r.f1_micro_diff == 0


def test_label_list_literals_and_encoding(spark):
    df = spark.createDataFrame([(1, "[0, 2]"), (2, "[1]")], "id long, s string")
    got = {r.id: r.v for r in df.select("id", C.parse_label_list("s").alias("v")).collect()}
    assert got == {1: [0, 2], 2: [1]}
    lab = spark.createDataFrame([(1, "b,a"), (2, "c")], "id long, label string")
    lm = C.label_index(lab, "label", multilabel=True)
    assert {r.label: r.idx for r in lm.collect()} == {"a": 0, "b": 1, "c": 2}
    enc = {r.id: r.label_idx for r in C.encode_labels(lab, "label", lm, multilabel=True).collect()}
    assert enc == {1: [1, 0], 2: [2]}
    single = spark.createDataFrame([(1, "x"), (2, "zz")], "id long, label string")
    lm1 = spark.createDataFrame([("x", 0)], "label string, idx int")
    out = {r.id: r.label_idx for r in C.encode_labels(single, "label", lm1).collect()}
    assert out == {1: 0, 2: None}
    hot = lab.select(C.multi_hot(F.array(F.lit(0), F.lit(2)), 3).alias("h")).first().h
    assert hot == [1, 0, 1]
