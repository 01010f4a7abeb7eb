"""One plan at every size; no silent stop; explicit parameters."""

import pytest

from corpuslens.operators import classify, coref, quality, similarity, topics


def test_links_that_do_not_converge_raise(spark):
    links = spark.createDataFrame([("d", k + 1, k) for k in range(40)], "doc_key string, mention long, antecedent long")
    with pytest.raises(RuntimeError):
        coref.clusters_from_links(links, max_rounds=2)
    assert {r.root for r in coref.clusters_from_links(links).collect()} == {0}


def test_topic_vocabulary_keeps_every_term(spark):
    docs = spark.createDataFrame([(k, " ".join(f"word{'abcdefghij'[k]}{x}" for x in ("alpha", "beta", "gamma"))) for k in range(10)], "doc_id long, text string")
    assert topics.fit_topics(docs, k=2, passes=0).words.count() == 30


def test_unknown_metrics_are_rejected(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e")], "doc_id long, text string")
    for bad in (("nope",), ()):
        with pytest.raises(ValueError):
            similarity.compare_corpora(docs, docs, bad)
    assert similarity.compare_corpora(docs, docs.limit(1), ("text-length",)).first().value == -0.5


def test_label_map_round_trip(spark, tmp_path):
    lm = classify.label_index(spark.createDataFrame([("b",), ("a",), ("b",)], "label string"), "label")
    classify.save_label_map(lm, str(tmp_path / "m"))
    assert sorted(map(tuple, classify.load_label_map(spark, str(tmp_path / "m")).collect())) == [("a", 0), ("b", 1)]


def test_nearest_k_rows_and_ties(spark):
    syn = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    real = spark.createDataFrame([(k, [1.0, float(k // 2)]) for k in range(6)], "vec_id long, embedding array<double>")
    got = quality.nearest_real(syn, real, k=3, real_rows=2, fan=2).orderBy("rank").collect()
    assert [(r.rank, r.real_id) for r in got] == [(1, 0), (2, 1), (3, 2)]


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace as N

    from corpuslens import session
    unset = N(isEmpty=lambda: True)
    sc = N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(N(conf=N(get=lambda *_: None), sparkContext=sc))


def test_model_recogniser_and_rules(spark):
    from corpuslens.operators import descriptive as D
    docs = spark.createDataFrame([(1, "call +49 30 1234 5678 on 2024-05-06 or 7/8/2025"), (2, None), (3, "Rome and Oslo")], "doc_id long, text string")
    assert [(r.entity, r.label) for r in D.extract_entities(docs).orderBy("doc_id", "pos").collect()] == [
        ("+49 30 1234 5678", "PHONE"), ("2024-05-06", "DATE"), ("7/8/2025", "DATE")]
    cities = {"Rome", "Oslo"}
    got = D.extract_entities(docs, model=lambda t: [(w, "CITY") for w in t.split() if w in cities]).collect()
    assert [tuple(r) for r in got] == [(3, 0, "Rome", "CITY"), (3, 1, "Oslo", "CITY")]
