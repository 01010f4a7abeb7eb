import math

import numpy as np
from pyspark.sql import functions as F

from corpuslens.operators import filters as FL
from corpuslens.operators import quality as Q


def test_filter_cases(spark):
    long_text = " ".join(f"word{i}" for i in range(300)) + " alpha beta."
    rep = " ".join(["same"] * 21 + [f"w{i}" for i in range(279)])
    rows = [(0, "Intro None. " + long_text), (1, long_text + " None None tail"), (2, "no period here"),
            (3, ""), (4, "one two three four five six"), (5, rep), (6, "short distinct " * 3)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r for r in FL.discard_filter(df, "t").collect()}
    assert got[0].t == "Intro  " + long_text and got[1].t == long_text + " "
    assert got[3].reason == "few_distinct_words"
    ok = {r.id: r.ok for r in df.select("id", FL.repetition_ok(F.col("t")).alias("ok")).collect()}
    assert ok[3] is True and ok[4] is False and ok[5] is False
    trunc = {r.id: r.t for r in FL.truncate_to_last_period(df, "t").collect()}
    assert trunc[2] == "" and trunc[6] == ""


def test_normalise(spark):
    df = spark.createDataFrame([("The Cats, 42 of them, are HERE!",)], "t string")
    assert df.select(FL.normalise_text(F.col("t")).alias("n")).first().n == "cats"


def test_mauve_identical_is_one(spark):
    h = spark.createDataFrame([(c, s, n) for c, n in [(0, 5), (1, 3), (2, 9)] for s in ("synthetic", "real")],
                              "cluster int, corpus string, cnt long")
    assert abs(Q.mauve_from_histogram(h).first().mauve - 1.0) < 1e-9
    h2 = spark.createDataFrame([(0, "synthetic", 10), (1, "real", 10)], "cluster int, corpus string, cnt long")
    assert Q.mauve_from_histogram(h2).first().mauve < 0.05


def test_frechet_and_centroid(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(200, 4))
    b = rng.normal(loc=1.0, size=(150, 4))
    da = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "vec_id long, embedding array<double>")
    db = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(b)], "vec_id long, embedding array<double>")
    got = Q.frechet_distance(da, db).first().frechet
    m1, m2 = a.mean(0), b.mean(0)
    s1, s2 = np.cov(a, rowvar=False), np.cov(b, rowvar=False)
    w, v = np.linalg.eig(s1 @ s2)
    exp = ((m1 - m2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * np.sqrt(w.real.clip(0)).sum()
    assert abs(got - exp) < 1e-6
    scores, summary = Q.centroid_cosine(da, db)
    c = a.mean(0)
    exp_syn = np.mean([x @ c / np.linalg.norm(x) / np.linalg.norm(c) for x in a])
    got_syn = {r.corpus: r.mean_score for r in summary.collect()}["synthetic"]
    assert abs(got_syn - exp_syn) < 1e-9


def test_nearest_real_block_path(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(40, 3))
    da = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(a)], "vec_id long, embedding array<double>")
    db = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(b)], "vec_id long, embedding array<double>")
    an = a / np.linalg.norm(a, axis=1, keepdims=True)
    bn = b / np.linalg.norm(b, axis=1, keepdims=True)
    exp = (an @ bn.T).argmax(axis=1)
    for kw in ({}, {"syn_rows": 5, "real_rows": 7, "fan": 2}):
        got = {r.syn_id: r.real_id for r in Q.nearest_real(da, db, **kw).collect()}
        assert got == {i: int(exp[i]) for i in range(30)}


def test_perplexity_from_losses(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.0), (1, 1.5)], "seq_id long, loss double")
    assert abs(Q.perplexity_from_losses(df).first().ppl - math.exp(1.0)) < 1e-12
