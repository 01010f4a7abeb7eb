"""Null, empty and repeated rows in operators over vectors, texts and ids."""

import os

from pyspark.sql import functions as F

from corpuslens.operators import canary as K
from corpuslens.operators import quality as Q
from corpuslens.operators import ranking as R
from corpuslens.operators import records as RC
from corpuslens.operators import similarity as S
from corpuslens.session import materialise, scratch_scope

VECTORS = "vec_id {}, embedding array<float>"
BAD = [(90, None), (91, [1.0, None]), (92, [float("nan"), 0.0]), (93, [float("inf"), 0.0])]


def test_nearest_real_ignores_broken_vectors_and_takes_any_id(spark):
    syn = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0]), (None, [1.0, 1.0]), *[(str(i), v) for i, v in BAD]], VECTORS.format("string"))
    real = spark.createDataFrame([("x", [2.0, 0.1]), ("y", [0.0, 1.0]), *[(str(i), v) for i, v in BAD]], VECTORS.format("string"))
    got = {(r["syn_id"], r["rank"]): (r["real_id"], round(r["cosine"], 4)) for r in Q.nearest_real(syn, real, k=2).collect()}
    assert got == {("a", 1): ("x", 0.9988), ("a", 2): ("y", 0.0), ("z", 1): ("x", 0.0), ("z", 2): ("y", 0.0)}
    assert Q.nearest_real(syn, real.filter("vec_id like '9%'")).collect() == []


def test_frechet_of_broken_and_empty_sides(spark):
    rows = [(k, [float(k % 3), float(k % 5)]) for k in range(20)]
    whole = spark.createDataFrame(rows, VECTORS.format("int"))
    broken = spark.createDataFrame(rows + BAD, VECTORS.format("int"))
    got = Q.frechet_distance(whole, broken).first()
    assert (got["n_a"], got["n_b"]) == (20, 20) and abs(got["frechet"]) < 1e-9
    for side in (whole.filter("false"), whole.limit(1), broken.filter("vec_id >= 90")):
        assert Q.frechet_distance(whole, side).first()["frechet"] is None


def test_jaccard_of_null_texts(spark):
    a = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id int, text string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "doc_id int, text string")
    assert abs(S.jaccard_mean(a, b).first()[0] - 0.5 / 4) < 1e-12  # two pairs of empty texts are left out
    assert S.jaccard_mean(a.filter("doc_id = 2"), b.filter("doc_id > 1")).first()[0] is None


def test_canaries_go_into_texts_only(spark):
    data = spark.createDataFrame([(k, None if k % 2 else f"Text {k}. More.") for k in range(12)], "doc_id int, text string")
    canaries = spark.createDataFrame([("My code is 123.", "123", "number")], "sentence string, secret string, type string")
    got = K.insert_canaries(data, canaries, copies=5).collect()
    hit = [r for r in got if r["canary"] != "no_canary"]
    assert len(got) == 12 and len(hit) == 5 and all("My code is 123." in r["text"] for r in hit)


def test_ordered_rank(spark):
    values = [-5, 0, 3, 10 ** 15, 7, 8, 2 ** 62, -2 ** 62]
    df = spark.createDataFrame([(v, str(v)) for v in values], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["rank"] for r in R.ordered_rank(df, "doc_id").collect()} == {v: i + 1 for i, v in enumerate(sorted(values))}
    assert R.ordered_rank(df.filter("false"), "doc_id").collect() == []


def test_control_codes_of_repeated_ids(spark):
    mention = "struct<entity_type:string,identifier_type:string,span_text:string>"
    rows = [("d", "Ann met Bo in Rome.", {"x": ([("PERSON", "DIRECT", "Ann"), ("LOC", "QUASI", "Rome"), ("PERSON", "DIRECT", "Bo"), ("ORG", "NO_MASK", "met")],), "w": ([("LOC", "DIRECT", "Bo")],)}),
            ("d", "Cy.", {"x": ([("PERSON", "QUASI", "Cy"), ("PERSON", "DIRECT", "absent")],)}), ("e", None, None), ("f", "No one.", {"x": ([],)})]
    df = spark.createDataFrame(rows, f"doc_id string, text string, annotations map<string,struct<entity_mentions:array<{mention}>>>")
    got = sorted(tuple(r) for r in RC.control_code_lines(df).collect())
    assert got == [("d", "PERSON: Ann, Bo\nLOC: Rome"), ("d", "PERSON: Cy")]


def test_scratch_scope_deletes_its_tables(spark):
    kept = materialise(spark.range(5), "outer")
    with scratch_scope(spark):
        inner = materialise(spark.range(7), "inner")
        folder = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
        result = materialise(inner.filter(F.col("id") > 2), "result").collect()
        assert os.path.isdir(folder)
    assert len(result) == 4 and not os.path.exists(folder) and kept.count() == 5
