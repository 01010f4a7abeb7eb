import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import queries as Q
from corpuslens.llm import quality_pu as P


def samples(prior, n=4000, seed=0):
    rng = np.random.default_rng(seed)
    good = lambda k: rng.normal(0, 1, (k, 14))
    bad = lambda k: rng.normal(2.0, 1, (k, 14))
    k = int(n * prior)
    return good(n), np.concatenate([good(k), bad(n - k)]), good(n), bad(n)


def test_prior_and_risk_on_known_mixtures():
    for prior in (0.3, 0.6, 0.87):
        pos, unl, good, bad = samples(prior)
        m = P.fit_samples(pos, unl)
        assert abs(m.prior - prior) < 0.08
        assert (m.score(good) >= 0.3).mean() > 0.97 and (m.score(bad) < 0.3).mean() > 0.9


def test_gradient_step_of_the_risk():
    pos, unl, *_ = samples(0.5, 500)
    w, b = P.minimise(pos, unl, 0.5, steps=200)
    def risk(w, b):
        loss = lambda x, y: np.logaddexp(0, -y * (x @ w + b)).mean()
        return 0.5 * loss(pos, 1) + max(0, loss(unl, -1) - 0.5 * loss(pos, -1))
    assert risk(w, b) < risk(np.zeros(14), 0.0)


def test_statistics_of_hard_texts():
    for t in ["", " \n", "!!!", "word " * 50_000, "漢字 Ünder | | |\nx\nx", "\U0001f600 a"]:
        s = P.statistics(t)
        assert len(s) == len(P.STATISTICS) and np.isfinite(s).all()


def test_hard_rows(spark):
    rows = [(i, "plain words that go on in prose, number %d and more." % i) for i in range(40)] + [(50, None), (51, ""), (None, "x y"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1)).withColumn("score", F.lit(1))
    f = P.featurise(df)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (99, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    out = P.score(f, P.fit(f, labels, F.col("doc_id").isNotNull())).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    none = P.fit(f, labels.limit(0), F.lit(True))
    assert none is None and {r.score for r in P.score(f, none).collect()} == {0.5}
    empty = P.featurise(df.limit(0))
    assert P.score(empty, P.fit(empty, labels, F.lit(True))).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.QUERIES["op9_quality_pu"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(out) > 40
    assert sum(r.predicted == r.quality for r in out) / len(out) > 0.95
    good = [r for r in out if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.97
