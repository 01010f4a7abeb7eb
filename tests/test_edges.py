import re

from pyspark.sql import functions as F

from corpuslens.operators import privacy, search, similarity
from corpuslens.streaming import monitor


def test_null_empty_and_unicode(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "Zoë's café near ZOË plaza"), (3, "ΣΟΦΙΑ met σοφια"),
                                  (4, "word")], "doc_id long, text string")
    ents = spark.createDataFrame([(0, "zoë"), (1, "Café"), (2, "σοφια"), (3, "word"), (4, "")],
                                 "entity_id long, entity string")
    got = {(r.doc_id, r.entity_id) for r in search.entity_mentions(docs, ents).collect()}
    exp = set()
    for d, t in [(1, ""), (2, "Zoë's café near ZOË plaza"), (3, "ΣΟΦΙΑ met σοφια"), (4, "word")]:
        for e, s in [(0, "zoë"), (1, "Café"), (2, "σοφια"), (3, "word"), (4, "")]:
            if re.search(r"\b" + re.escape(s) + r"\b", t, re.IGNORECASE):
                exp.add((d, e))
    assert got == exp
    roll = privacy.entity_leakage(docs.filter(F.col("text").isNotNull()), ents).first()
    assert roll.n_docs == 4


def test_permutation_invariance(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    syn = docs.filter(F.col("doc_id") % 2 == 0)
    ref = docs.filter(F.col("doc_id") % 2 == 1)
    a = similarity.compare_corpora(syn, ref).collect()
    shuffled_syn = syn.withColumn("doc_id", F.col("doc_id") * 7919 % 100003)
    b = similarity.compare_corpora(shuffled_syn.repartition(3), ref).collect()
    va = {r.metric: r.value for r in a}
    vb = {r.metric: r.value for r in b}
    assert va.keys() == vb.keys()
    for k in va:
        assert va[k] == vb[k] or abs(va[k] - vb[k]) < 1e-9


def test_filter_stream_matches_batch(spark, sf, tmp_path):
    import shutil
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{sf}/documents.parquet", src / "part-0.parquet")
    batch_df = spark.read.parquet(str(src)).select("doc_id", "text")
    stream = monitor.document_stream(spark, str(src), spark.read.parquet(str(src)).schema).select("doc_id", "text")
    out = str(tmp_path / "out")
    q = monitor.start(monitor.filter_stream(stream, "text"), "filter_test", path=out)
    q.awaitTermination()
    streamed = {(r.doc_id, r.keep, r.reason) for r in spark.read.parquet(out).collect()}
    from corpuslens.operators.filters import discard_filter
    batch = {(r.doc_id, r.keep, r.reason) for r in discard_filter(batch_df, "text").collect()}
    assert streamed == batch
