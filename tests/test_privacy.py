import re

from pyspark.sql import functions as F

from corpuslens.operators import privacy, search

PARAGRAPH = (
    "Reporter Nora Vance had covered many stories, but a tip from an engineer at Quillon Labs \n"
    "changed everything. The papers traced money to Judge \nMarcus Hale and to Stonegate Partners, "
    "a fund based in Denver, Colorado.\n\nNora kept digging; Quillon Labs denied it. Her contact, the "
    "analyst Petra Lind (ex-NSA), warned her. Jr. Smith was not involved, nor was C++ expert Ana."
)
ENTITIES = ["Nora Vance", "Quillon Labs", "Judge Marcus Hale", "Stonegate Partners", "Denver",
            '"Colorado"', "Petra Lind", "Jr.", "C++", "(ex-NSA)", "nobody here"]


def _python_hits(texts, entities):
    out = set()
    for i, t in enumerate(texts):
        for j, e in enumerate(entities):
            c = e.strip('"')
            if re.search(r"\b" + re.escape(c) + r"\b", t, re.IGNORECASE):
                out.add((i, j))
    return out


def _frames(spark, texts, entities):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ents = spark.createDataFrame(list(enumerate(entities)), "entity_id long, entity string")
    return docs, ents


def test_leakage_matches_python_re(spark):
    docs, ents = _frames(spark, [PARAGRAPH], ENTITIES)
    got = {(r.doc_id, r.entity_id) for r in search.entity_mentions(docs, ents).collect()}
    assert got == _python_hits([PARAGRAPH], ENTITIES)
    # the title+name entity is broken by a newline, so it is not found
    assert (0, 2) not in got and (0, 4) in got and (0, 5) in got


def test_leakage_shuffle_path_equals_broadcast_path(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ents = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("entity_id"), F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("entity"))
    a = {tuple(r) for r in search.entity_mentions(docs, ents).collect()}
    b = {tuple(r) for r in search.entity_mentions(docs, ents).collect()}
    assert a == b
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    ids = [r.doc_id for r in docs.orderBy("doc_id").collect()]
    elist = [(r.entity_id, r.entity) for r in ents.collect()]
    brute = {(ids[i], elist[j][0]) for i, j in _python_hits(texts, [e for _, e in elist])}
    assert {(d, e) for d, e, _ in a} == brute


def test_entity_leakage_rollup(spark):
    docs, ents = _frames(spark, [PARAGRAPH, "nothing to see"], ENTITIES)
    row = privacy.entity_leakage(docs, ents).first()
    n = len(_python_hits([PARAGRAPH], ENTITIES))
    assert row.n_docs == 2 and row.n_leaked == n
    assert abs(row.avg_leaked_per_doc - n / 2) < 1e-12


def _python_phrases(texts, patterns, window=3):
    out = []
    for doc in texts:
        for p in patterns:
            pat = re.compile(r"((?:\S+\s+){0,%d})%s((?:\s+\S+){0,%d})" % (window, re.escape(p), window))
            for m in pat.finditer(doc):
                words = m.group(0).strip().split()
                n = len(words)
                for w in range(window):
                    s = " ".join(words[w:n - w]).strip()
                    if p in s:
                        out.append((p, s, window - w))
    return out


def test_context_phrases_match_python(spark):
    texts = [PARAGRAPH[:120], PARAGRAPH]
    docs, ents = _frames(spark, texts, ENTITIES)
    got = sorted((r.entity, r.phrase, r.context_len)
                 for r in search.context_phrases(docs, ents, window=3).collect())
    assert got == sorted(_python_phrases(texts, ENTITIES))


def test_span_memorisation_counts(spark):
    syn, ents = _frames(spark, [PARAGRAPH[:100]], ENTITIES)
    ref = spark.createDataFrame([(0, PARAGRAPH)], "doc_id long, text string")
    got = {r.context_len: r["count"] for r in privacy.span_memorisation(syn, ref, ents, window=3).collect()}
    phrases = set(_python_phrases([PARAGRAPH[:100]], ENTITIES))
    exp = {}
    for _, s, c in phrases:
        if s in PARAGRAPH:
            exp[c] = exp.get(c, 0) + 1
    assert got == exp
    # shrinking the reference never increases the counts
    small = spark.createDataFrame([(0, PARAGRAPH[:60])], "doc_id long, text string")
    got2 = {r.context_len: r["count"] for r in privacy.span_memorisation(syn, small, ents, window=3).collect()}
    assert all(got2.get(k, 0) <= v for k, v in got.items())


def test_phrase_semijoin_shuffle_path(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ph = docs.select(F.explode(F.slice(F.split("text", " "), 1, 4)).alias("w")).limit(0)
    phrases = spark.createDataFrame([("the of",), ("is a",), ("zz qq yy",)], "phrase string").unionByName(
        docs.select(F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("phrase")))
    a = {r.phrase for r in search.phrases_found_in(phrases, docs).collect()}
    b = {r.phrase for r in search.phrases_found_in(phrases, docs).collect()}
    texts = [r.text for r in docs.collect()]
    brute = {p.phrase for p in phrases.collect() if any(p.phrase in t for t in texts)}
    assert a == b == brute
    assert ph.count() == 0


def test_rarest_key_equals_longest_key(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    ents = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        F.col("item_id").alias("entity_id"), F.array_join(F.slice(F.split("text", " "), 2, 3), " ").alias("entity"))
    extra = spark.createDataFrame([(1000, "the"), (1001, '"!!"'), (1002, "Nora Vance")], "entity_id long, entity string")
    ents = ents.unionByName(extra)
    a = {tuple(r) for r in search.entity_mentions(docs, ents).collect()}
    b = {tuple(r) for r in search.entity_mentions(docs, ents, key="rarest").collect()}
    c = {tuple(r) for r in search.entity_mentions(docs, ents, key="rarest").collect()}
    assert a == b == c


SHORT = ["Chicago", "a", "in D", "Labs", "ler", " \n", " ", "C++", "Nora Vance", "(ex-NSA)", "was n", "Jr.", "Judge \nMarcus", "enver, C", "", "tip from an engineer"]


def test_short_needles_equal_python(spark):
    texts = [PARAGRAPH, PARAGRAPH[:90], "Chicago  in Denver", "", "a"]
    docs, ents = _frames(spark, texts, SHORT)
    got = sorted((r.entity, r.phrase, r.context_len) for r in search.context_phrases(docs, ents).collect())
    assert got == sorted(_python_phrases(texts, [e for e in SHORT if e]))
    found = {r.entity for r in search.phrases_found_in(ents, docs, phrase_col="entity").collect()}
    assert found == {e for e in SHORT if any(e in t for t in texts)}


def test_entities_without_words_equal_python(spark):
    texts = [PARAGRAPH, "a!!b", "a !! b", "x\nY", "--", "", "é"]
    ents = SHORT + ["!!", '"!!"', " !! ", ", ", "\n", '""', "--", "É"]
    docs, es = _frames(spark, texts, ents)
    for key in ("longest", "rarest"):
        got = {(r.doc_id, r.entity_id) for r in search.entity_mentions(docs, es, key=key).collect()}
        assert got == _python_hits(texts, ents)


def test_no_nested_loop_in_any_search_plan(spark, sf):
    from corpuslens.plans import registry
    qs = registry.all_queries()
    for threshold in ("10485760", "-1"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            for name in ("leakage_pairs", "leakage_detail", "epo_phrases", "epo_counts", "epo_found_phrases", "epo_overlap_ratio", "leakage_pairs_rarest_key"):
                plan = qs[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
                assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_stream_search_is_stateless(spark, sf):
    import pytest
    docs = spark.readStream.schema(spark.read.parquet(f"{sf}/documents.parquet").schema).option("pathGlobFilter", "documents.parquet").parquet(sf)
    ents = spark.createDataFrame([(1, "the"), (2, "!!")], "entity_id long, entity string")
    plan = search.entity_mentions(docs, ents)._jdf.queryExecution().logical().toString()
    hits = search.entity_mentions(docs, ents)
    q = hits.writeStream.format("memory").queryName("stateless_hits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert not q.lastProgress["stateOperators"] and plan
    with pytest.raises(ValueError):
        search.entity_mentions(docs, ents, key="rarest")
    with pytest.raises(ValueError):
        search.context_phrases(docs, ents)


def test_neighbour_keys(spark):
    """Entities of several words meet only the documents that hold two of them side by side."""
    from corpuslens.operators import search
    docs = spark.createDataFrame([(1, "Anna met ANNA  Bo-Lee."), (2, "Lee Bo, Anna."), (3, "anna bo-lee, x"), (4, None), (5, "--")], "doc_id int, text string")
    ents = spark.createDataFrame([(1, "Anna Bo-Lee"), (2, "Anna"), (3, "bo-lee"), (4, "Lee Bo"), (5, ", x"), (6, "Anna  Bo")], "entity_id int, entity string")
    rows = lambda key: {tuple(r) for r in search.entity_mentions(docs, ents, key=key).collect()}
    assert rows("neighbours") == rows("longest") and len(rows("longest")) >= 7
    keys = search.neighbours(search.word_runs(F.lit("Anna Bo-Lee")))
    assert docs.limit(1).select(keys.alias("k")).first()["k"] == ["anna\x01bo", "bo\x01lee"]


def test_many_entities_meet_few_tokens(spark, monkeypatch):
    """More entities than are sent at once: only tokens that may be a key are shuffled, and
    pairs are numbers; repeated words meet the texts that hold as many of them, or 8, in a row."""
    import random

    from corpuslens.operators import search
    rng = random.Random(9)
    word = lambda: rng.choice(["die", "Die", "\u017fie", "die,", "la", "LA", "o'la", "\u212aa", "ka", "stra\u00dfe", "\u00b5", "i\u0307", "-"])
    texts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["die " * 20, "Die Die Die", "\x01die\x01 die", None, "a.b. c"]
    names = ["Die " * k + "Die" for k in range(12)] + ["la die", "die, la", "Ka", "o'la", "\u00b5", "STRA\u00dfE", "-", " ", "", ". c", "a.b", ", die", "die la die la", "sie", '"la"', "la\n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").unionByName(spark.createDataFrame([(0, "la die"), (None, "die die")], "doc_id int, text string"))
    ents = spark.createDataFrame([*enumerate(names), (None, "die")], "entity_id int, entity string")
    rows = lambda key: sorted(map(str, search.entity_mentions(docs, ents, key=key).collect()))
    want = rows("longest")
    assert rows("neighbours") == want and len(want) > 100
    monkeypatch.setattr(search, "MOST_SENT", 5)
    few = search.entity_mentions(docs.filter("doc_id > 0"), ents, key="neighbours")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "_slot" in plan and all("_look" not in x and "_pat" not in x for x in plan.splitlines() if "HashAggregate" in x)
    unique = lambda key: sorted(map(str, search.entity_mentions(docs.filter("doc_id > 0"), ents, key=key).collect()))
    assert sorted(map(str, few.collect())) == unique("longest") == [r for r in want if "doc_id=0," not in r and "doc_id=None" not in r]
