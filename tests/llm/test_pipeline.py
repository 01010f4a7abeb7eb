import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpuslens.llm import quality_pu, secret_scan
from test_decontaminate import brute as brute_leaks
from test_simhash_dedup import slow_components, slow_fingerprint
from test_source_mixing import brute_targets

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in P.STAGES:
        out.append(P.materialise(f(spark, out[-1], SF), name))
        if name != "mixing":
            assert out[-1].dtypes == docs.dtypes
    return out


def test_quality_keeps_what_the_model_scores(spark, stages):
    training = F.col("doc_id").isNotNull() & (P.id_fold("doc_id", 5) != 0)
    model = quality_pu.fit(quality_pu.featurise(stages[0]), spark.read.parquet(f"{SF}/labels.parquet"), training)
    import numpy as np
    docs = stages[0].collect()
    score = model.score(np.array([quality_pu.statistics(r.text) for r in docs], np.float32).astype(float))
    want = {r.doc_id for r, s in zip(docs, score) if s >= 0.3}
    assert {r.doc_id for r in stages[1].collect()} == want


def test_near_duplicates(stages):
    docs = stages[1].collect()
    comp = slow_components([slow_fingerprint(r.text) for r in docs], 2)
    least = {}
    for r, c in zip(docs, comp):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert rows_of(stages[2]) == sorted((tuple(r) for r in docs if r.doc_id in set(least.values())), key=str)


def test_decontamination(spark, stages):
    docs = stages[2].collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in docs], items)}
    assert rows_of(stages[3]) == sorted((tuple(r) for r in docs if r.doc_id not in bad), key=str)


def test_secrets(stages):
    before, after = {r.doc_id: r for r in stages[3].collect()}, {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        b = before[i]
        assert (r.lang, r.source, r.n_chars) == (b.lang, b.source, len(r.text)) and not secret_scan.find_secrets(r.text)[0]
        assert r.text == b.text or secret_scan.find_secrets(b.text)[0]


def test_mixing(stages):
    docs, mixed = stages[4].collect(), stages[5].collect()
    size = {r.doc_id: len(r.text.encode().split()) for r in docs}
    sizes = {}
    for r in docs:
        sizes[r.source] = sizes.get(r.source, 0) + size[r.doc_id]
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        assert r.size == size[r.doc_id] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(mixed) == len(docs) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_run_equals_the_stages(spark, stages):
    assert rows_of(P.run(spark, SF)) == rows_of(stages[5])


def test_hard_rows_and_empty_tables(spark, tmp_path):
    path, schema = str(tmp_path), "doc_id long, text string, lang string, source string, n_chars long, fp string, x string, size int"
    prose = "Plain prose goes on here, with words of number %d in a row. " * 6
    rows = [(i, prose.replace("%d", f"n{i}") + f" closing word{i * i} more{i % 7} text{i % 11}", "en", "a", 9) for i in range(60)]
    rows += [(70, None, None, None, None), (71, "", "en", "b", 0), (72, "", None, "b", 0), (None, prose % ((0,) * 6), "en", None, 5), (3, *rows[3][1:]), (80, "password=abcdef123 in prose, with more words", "en", "a", None),
             (81, "word and prose, " * 15_000, "en", "c", 1)]
    bench = " ".join(f"item{i}" for i in range(30))
    rows += [(90, prose % ((1,) * 6) + bench, "en", "a", 1)]
    df = spark.createDataFrame([(*r, "f", "y", 3) for r in rows], schema)
    df.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    ids = [r.doc_id for r in P.run(spark, path).collect()]
    assert ids.count(3) == 1 and 90 not in ids and len(ids) > 10
    empty = str(tmp_path / "empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert P.run(spark, empty).count() == 0


def test_one_document_of_a_group_without_ids_or_with_repeated_ids(spark):
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(400))
    rows = [(None, text(1)), (None, text(1)), (None, text(1)), (5, text(2)), (None, text(2)), (7, text(3)), (7, text(4)), (6, text(4)), (8, text(5)), (8, text(5).upper()), (9, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, (r.text or "").lower()) for r in P.near_duplicates(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted([(None, text(1)), (5, text(2)), (7, text(3)), (6, text(4)), (8, text(5)), (9, "")], key=str)


def test_near_duplicates_leaves_columns_of_clashing_names_alone(spark):
    rows = [(1, "same words in here", "a", 7), (2, "same words in here", "b", 8), (2, "same words in here", "b", 8), (3, "quite another text it is", "c", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_key string, kept_id int")
    assert rows_of(P.near_duplicates(spark, docs, SF)) == [rows[0], rows[3]]
    again = spark.createDataFrame([rows[0], rows[0], rows[3]], docs.schema)
    assert rows_of(P.near_duplicates(spark, again, SF)) == [rows[0], rows[3]]
