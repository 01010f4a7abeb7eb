import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import queries
from corpuslens.llm.vector_codes import compress, decode, encode, fingerprint, fit, integer_vectors, nearest

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_nearest(x, book):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(row, e)) for e in book] for row in x]
    return [r.index(min(r)) for r in d], [min(r) for r in d]


@pytest.mark.parametrize("most", [3, 1000, 2 ** 40])
def test_equal_average_search_equals_brute_force(most):
    rng = np.random.default_rng(most)
    for width in (1, 3, 16):
        book = rng.integers(-most, most + 1, (40, width))
        book[7] = book[3]
        x = np.concatenate([rng.integers(-most, most + 1, (60, width)), book[:5]])
        index, d = nearest(x, book)
        assert (index.tolist(), [int(v) for v in d]) == brute_nearest(x.tolist(), book.tolist())


def brute(rows, parts, entries, rounds):
    """(codes, errors, books) of integer vectors in order of id."""
    width = len(rows[0]) // parts
    cut = [[r[p * width:(p + 1) * width] for r in rows] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]
    for k in range(rounds + 1):
        found = [brute_nearest(c, b) for c, b in zip(cut, books)]
        if k == rounds:
            break
        for p, (index, _) in enumerate(found):
            for e in range(len(books[p])):
                own = [v for v, i in zip(cut[p], index) if i == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    return list(zip(*[f[0] for f in found])), [sum(d) for d in zip(*[f[1] for f in found])], books


def test_equals_brute_force_with_ties_and_empty_entries(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 0.02, (90, 8)).astype(np.float32)
    v[40:50] = v[3]
    rows = [(int(i), [float(x) for x in r], int(i) % 3 if i % 7 else None) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    coded, books = compress(df, parts=2, entries=16, rounds=3)
    ints = [[int(np.floor(1024 * np.float64(x))) for x in r] for r in v]
    codes, errors, want = brute(ints, 2, 16, 3)
    assert [b.tolist() for b in books] == want
    assert fingerprint(books) == hashlib.sha256(",".join(str(x) for b in want for e in b for x in e).encode()).hexdigest()
    got = {r["vec_id"]: r for r in coded.collect()}
    assert [tuple(got[i]["code"]) for i in range(90)] == codes
    assert [got[i]["error"] for i in range(90)] == errors
    by_label = {}
    for (_, _, lab), e in zip(rows, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    assert all(got[i]["label_error"] == by_label[lab] for i, _, lab in rows)


def test_decode_gives_the_entries(spark):
    rows = [(i, [0.01 * i, -0.02 * i, 0.5, 0.25 * (i % 2)], 0) for i in range(6)]
    ints = integer_vectors(spark.createDataFrame(rows, SCHEMA))
    books = fit(ints, parts=2, entries=6, rounds=0)
    back = encode(ints, books).join(ints.select(F.col("id").alias("of"), "v"), F.col("id") == F.col("of")).select("v", decode(F.col("code"), books).alias("w"))
    assert all(r["v"] == r["w"] for r in back.collect())


def test_nulls_repeats_lengths_extremes(spark):
    rows = [(1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (None, [0.1, 0.9], None), (2, None, 1), (3, [0.1, None], 1), (4, [float("nan"), 0.1], 1),
            (5, [float("inf"), 0.1], 1), (6, [1.0, 2.0, 3.0], 1), (7, [3e38, -3e38], None)]
    coded, books = compress(spark.createDataFrame(rows, SCHEMA), parts=2, entries=4, rounds=2)
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["error"]) for r in coded.collect())
    assert [g[:2] for g in got] == [(False, 1), (False, 1), (False, 7), (True, 0)]
    assert all(len(b) == 4 for b in books)
    assert {r["label_error"] for r in coded.filter("label is null").collect()} == {sum(r["error"] for r in coded.filter("label is null").collect())}


def test_errors_stop_at_the_limit(spark):
    rows = [(1, [0.0, 0.0], 1), (2, [3e38, 3e38], 1), (3, [-3e38, 3e38], 1)]
    coded, _ = compress(spark.createDataFrame(rows, SCHEMA), parts=1, entries=1, rounds=0)
    assert {r["vec_id"]: r["error"] for r in coded.collect()} == {1: 0, 2: 2 ** 63 - 1, 3: 2 ** 63 - 1}
    assert {r["label_error"] for r in coded.collect()} == {2 ** 63 - 1}


def test_empty_table_clashing_columns_and_bad_length(spark):
    coded, books = compress(spark.createDataFrame([], SCHEMA))
    assert coded.collect() == [] and books == []
    rows = spark.createDataFrame([(1, [0.1, 0.2, 0.3], 1)], SCHEMA).withColumn("id", F.lit("x")).withColumn("v", F.lit(1)).withColumn("code", F.lit(0))
    assert compress(rows, parts=3)[0].count() == 1
    with pytest.raises(ValueError):
        compress(rows, parts=2)


def test_query_equals_brute_force(spark, sf):
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    x = np.floor(1024 * np.array([v for _, v in rows], np.float64)).astype(np.int64)
    books = [x[:256, p * 16:(p + 1) * 16].copy() for p in range(4)]
    for k in range(5):
        index = [((x[:, None, p * 16:(p + 1) * 16] - b[None]) ** 2).sum(axis=2) for p, b in enumerate(books)]
        codes, errors = [d.argmin(axis=1) for d in index], sum(d.min(axis=1) for d in index)
        if k < 4:
            for p, b in enumerate(books):
                for e in range(256):
                    if (own := codes[p] == e).any():
                        b[e] = x[own, p * 16:(p + 1) * 16].sum(axis=0) // own.sum()
    got = {r["vec_id"]: r for r in queries.op12(spark, sf).collect()}
    assert [got[i]["code"] for i, _ in rows] == ["".join(f"{c[k]:02x}" for c in codes) for k in range(len(rows))]
    assert [got[i]["error"] for i, _ in rows] == errors.tolist()
    assert {r["codebooks_sha256"] for r in got.values()} == {fingerprint(books)}
