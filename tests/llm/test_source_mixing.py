import random

import pytest

from corpuslens.llm import source_mixing as S


def brute_targets(sizes, weights=(3, 1, 2)):
    """Share, cap, share the excess again: the rule said word for word."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while open_ and left > 1e-9:
        unit, left = left / sum(w[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += unit * w[s]
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def make(spark, n=400, seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "Z", "zz", None, "tiny"]
    rows = [(i, "w " * rng.randrange(0, 60), sources[min(rng.randrange(12), 5)]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", None), (n + 2, "one", "tiny"), (7, rows[7][1], rows[7][2]), (None, "x y", "b"), (n + 3, "word\x0bword x " * 30000, "zz")]
    return rows


@pytest.mark.parametrize("per_bucket", [10, 20_000])
def test_targets_taken_and_order(spark, per_bucket):
    rows = make(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "'x' as target", "2 as bucket")
    got = S.mix(df, rows_per_bucket=per_bucket).collect()
    assert len(got) == len(rows)
    import re
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.passes)
        assert all(0 <= p.position <= 1 for p in r.passes)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    firsts = [r.passes[0].position if r.passes else 2 for r in got]
    assert firsts == sorted(firsts)
    again = S.mix(df.repartition(5), rows_per_bucket=per_bucket).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_schedule_inversion(spark):
    knots = ((0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 4.0))
    from pyspark.sql import functions as F
    us = [i / 50 for i in range(51)]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(S.inverse(knots, F.col("u"))).collect()]
    def used(t):
        return sum(S.integral([(a, wa), (b, wb)]) if t >= b else S.integral([(a, wa), (t, wa + (wb - wa) * (t - a) / (b - a))]) for (a, wa), (b, wb) in zip(knots, knots[1:]) if t > a) / S.integral(knots)
    assert all(abs(used(t) - u) < 1e-9 for u, t in zip(us, got))


def test_early_words_follow_the_schedule(spark):
    rows = [(i, "w " * 10, f"s{i % 3}") for i in range(3000)]
    order = S.training_order(S.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    half = [r for r in order if r.position < 0.5]
    share = lambda rs, s: sum(r.words for r in rs if r.source == s) / sum(r.words for r in order if r.source == s)
    assert abs(share(half, "s0") - 0.625) < 0.02 and abs(share(half, "s1") - 0.5) < 0.02 and abs(share(half, "s2") - 0.375) < 0.02


def test_empty(spark):
    assert S.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
