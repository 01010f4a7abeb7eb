import math
import random

from pyspark.sql import functions as F

from corpuslens.llm import topk_search as S


def brute(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, (v, len(v))), (v, len(v)))
    out = []
    for i, (v, _) in asked.items():
        product = lambda w: max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w))))
        near = sorted((-product(w), j) for j, w in ok if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def rows(rng, n, d=5):
    out = [(i, [rng.choice([rng.uniform(-1, 1), 0.25]) for _ in range(d)]) for i in range(n)]
    out += [(n, None), (n + 1, [1.0, None, 2.0, 1.0, 1.0]), (n + 2, [float("nan")] * d), (n + 3, [float("inf")] * d), (None, [1.0] * d)]
    out += [(n + 10 + i, [0.5] * d) for i in range(60)] + [(20, [0.1] * d), (33, out[33][1]), (n + 90, [0.5, 0.5]), (n + 91, [0.5, 0.1]), (n + 99, [])]
    return out


def run(spark, data, **kw):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("v", F.lit(1))
    return sorted(tuple(r) for r in S.search(df, F.col("vec_id") % 10 == 0, k=7, **kw).collect())


def test_equals_brute_force(spark):
    data = rows(random.Random(1), 300)
    assert run(spark, data) == brute(data, 7, 10)


def test_many_tiles_and_tree_levels(spark):
    data = rows(random.Random(2), 300)
    assert run(spark, data, shard_rows=20, block_rows=9, fan=3) == brute(data, 7, 10)


def test_large_components_and_empty(spark):
    data = [(i, [(-1) ** i * 3e9 * (i + 1), 2e9]) for i in range(20)]
    assert run(spark, data) == brute(data, 7, 10)
    assert run(spark, []) == []
    assert run(spark, [(10, [1.0])]) == []
