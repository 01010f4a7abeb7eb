import json
import os
import tempfile

from pyspark.sql import functions as F

from corpuslens.operators import coref as CO
from corpuslens.operators import records as RC
from corpuslens.sources import corpus as S


def _tmp():
    return tempfile.mkdtemp(prefix="corpuslens-src-")


def test_splits_and_corpus_csv(spark):
    d = _tmp()
    for name in ("train", "validation", "test", "synthetic"):
        with open(os.path.join(d, f"{name}.csv"), "w") as f:
            f.write('id,text,label\n1,"a ""quoted""\nmulti-line text",x\n2,plain,y\n')
    df = S.read_splits(spark, d)
    assert df.count() == 8 and set(r.split for r in df.select("split").distinct().collect()) == {
        "train", "validation", "test", "synthetic"}
    c = S.load_corpus(spark, os.path.join(d, "train.csv"), fmt="csv", id_col="id", multi_line=True)
    texts = sorted(r.text for r in c.collect())
    assert texts[0] == 'a "quoted"\nmulti-line text'


def test_annotations_reader_and_control_codes(spark):
    d = _tmp()
    rec = [{"doc_id": "r1", "text": "Alice Brown lives here.\nMore text.",
            "annotations": {"b": {"entity_mentions": [{"entity_type": "PERSON", "identifier_type": "DIRECT",
                                                       "span_text": "Alice Brown"}]},
                            "a": {"entity_mentions": [{"entity_type": "PERSON", "identifier_type": "DIRECT",
                                                       "span_text": "Alice Brown"},
                                                      {"entity_type": "LOC", "identifier_type": "NO_MASK",
                                                       "span_text": "here"}]}},
            "meta": {"countries": "UK", "year": 2001}},
           {"doc_id": "r2", "text": "Nothing.", "annotations": None, "meta": {"countries": "FR", "year": 1999}}]
    p = os.path.join(d, "ann.json")
    with open(p, "w") as f:
        json.dump(rec, f)
    df = S.read_annotations(spark, p)
    assert df.count() == 2
    m = RC.annotation_mentions(df, types=["PERSON"])
    assert m.count() == 2  # both annotators, duplicates kept
    codes = {r.doc_id: r.control_codes for r in RC.control_code_lines(df).collect()}
    assert codes == {"r1": "PERSON: Alice Brown"}
    back = [r.entity for r in RC.parse_control_codes(RC.control_code_lines(df)).collect()]
    assert back == ["Alice Brown"]
    cc = df.select(RC.control_code(F.col("meta.countries"), F.col("meta.year")).alias("c")).first().c
    assert cc in ("Countries: UK, Year: 2001", "Countries: FR, Year: 1999")


def test_coref_jsonl_and_stats(spark):
    d = _tmp()
    p = os.path.join(d, "c.jsonl")
    docs = [{"doc_key": "a", "sentences": [["Hi", "there"], ["Bye"]], "speakers": [["x", "x"], ["y"]],
             "constituents": [], "ner": [], "clusters": [[[0, 0], [2, 2]], [[1, 1]]]},
            {"doc_key": "b", "sentences": [["x"]], "speakers": [["-"]], "constituents": [], "ner": [], "clusters": []}]
    with open(p, "w") as f:
        for x in docs:
            f.write(json.dumps(x) + "\n")
    df = S.read_coref_jsonl(spark, p)
    st = CO.doc_stats(df).first()
    assert (st.max_mentions, st.max_cluster_size, st.max_clusters) == (3, 2, 2)
    m = S.coref_mentions(df)
    assert m.count() == 3
    nested = CO.nest_clusters(m.select("doc_key", F.col("cluster").cast("string").alias("cluster"), "start", "end"))
    assert nested.filter(F.col("doc_key") == "a").first().clusters == [[[0, 0], [2, 2]], [[1, 1]]]
    empty = spark.createDataFrame([], df.schema)
    st0 = CO.doc_stats(empty).first()
    assert (st0.max_mentions, st0.max_cluster_size, st0.max_clusters) == (-1, -1, -1)


def test_ingest_and_sinks(spark):
    d = _tmp()
    a, b = os.path.join(d, "a.csv"), os.path.join(d, "b.csv")
    with open(a, "w") as f:
        f.write("text,n\nhello,1\nworld,2\n")
    with open(b, "w") as f:
        f.write("text,n\nagain,3\n")
    df = S.ingest_csvs(spark, [a, b], "text", sample_size=2)
    assert df.count() == 2
    import pytest
    with pytest.raises(ValueError):
        S.ingest_csvs(spark, [os.path.join(d, "x.txt")], "text")
    out = os.path.join(d, "metrics")
    row = spark.createDataFrame([("m1", 0.5)], "model_name string, f1 double")
    S.append_result(row, out)
    S.append_result(row, out)
    assert spark.read.parquet(out).count() == 2
    S.write_result(row, os.path.join(d, "label_map"), fmt="json")
    assert spark.read.json(os.path.join(d, "label_map")).count() == 1


def test_sentences(spark):
    df = spark.createDataFrame([(1, "Hello there. How are you? Fine!")], "doc_key long, text string")
    r = CO.sentences(df).first()
    assert r.sentences == [["hello", "there", "."], ["how", "are", "you", "?"], ["fine", "!"]] or \
        [len(s) for s in r.sentences] == [3, 4, 2]


def test_first_annotator_is_the_first_in_the_record(spark, tmp_path):
    import json

    from corpuslens.operators import records
    from corpuslens.sources.corpus import read_annotations
    mention = lambda t, s: {"entity_type": t, "identifier_type": "DIRECT", "span_text": s}
    rec = {"doc_id": "d1", "text": "Ana met Bo in Rome.", "annotations": {"annotator9": {"entity_mentions": [mention("PERSON", "Ana"), mention("LOC", "Rome"), mention("PERSON", "Bo")]},
                                                                        "annotator1": {"entity_mentions": [mention("PERSON", "Bo")]}}}
    (tmp_path / "a.json").write_text(json.dumps([rec]))
    df = read_annotations(spark, str(tmp_path / "a.json")).withColumn("doc_id", F.lit("d1"))
    assert records.control_code_lines(df).first().control_codes == "PERSON: Ana, Bo\nLOC: Rome"


def test_ties_keep_first_appearance(spark):
    from collections import Counter

    from corpuslens.operators import records
    rows = [(1, ["z", "b"]), (2, ["a", "z"]), (3, ["b", "a"]), (4, ["c"])]
    df = spark.createDataFrame(rows, "id long, codes array<string>")
    want = [v for v, _ in Counter(x for _, c in rows for x in c).most_common(3)]
    got = [r.value for r in records.top_k_values(df, "codes", 3, "id").orderBy("rank").collect()]
    assert got == want == ["z", "b", "a"]


def test_author_pointer_advances_only_when_drawn(spark):
    import hashlib

    from corpuslens.operators import records
    rows = [(a, 100 * a + k) for a in range(12) for k in range(a % 4 + 1)]
    df = spark.createDataFrame(rows, "author long, id long")
    got = sorted(tuple(r) for r in records.poisson_author_sample(df, "author", "id", q=0.5, rounds=9).collect())
    want, pointer = [], {}
    for r in range(9):
        for a in range(12):
            if int(hashlib.md5(f"0:{a}:{r}".encode()).hexdigest()[:8], 16) / 4294967296.0 < 0.5:
                own = sorted(i for x, i in rows if x == a)
                want.append((r, a, own[pointer.get(a, 0) % len(own)]))
                pointer[a] = pointer.get(a, 0) + 1
    assert got == sorted(want)


def test_seeded_order_without_a_sample_size(spark):
    from corpuslens.operators import ranking
    df = spark.range(50)
    every = [r.id for r in ranking.seeded_sample(df, "id", -1).collect()]
    assert sorted(every) == list(range(50)) and every != list(range(50)) and every[:7] == [r.id for r in ranking.seeded_sample(df, "id", 7).collect()]


def test_shuffled_author_batches(spark):
    import hashlib

    from corpuslens.operators import records
    rows = [(a, 100 * a + k) for a in range(11) for k in range(a % 3 + 1)] + [(None, 5)]
    df = spark.createDataFrame(rows, "author long, id long")
    got = sorted(tuple(r) for r in records.shuffled_author_batches(df, "author", "id", batch_size=4, epochs=3).collect())
    want, pointer = [], {}
    for e in range(3):
        order = sorted(range(11), key=lambda a: hashlib.md5(f"0:{e}:{a}".encode()).hexdigest())
        for i, a in enumerate(order[:8]):
            own = sorted(i for x, i in rows if x == a)
            want.append((e, i // 4, a, own[pointer.get(a, 0) % len(own)]))
            pointer[a] = pointer.get(a, 0) + 1
    assert got == sorted(want)
