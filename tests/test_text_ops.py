"""Treebank tokens, learnt sentence cuts, lemmas, quoted CSV, repeated appends, Kneser-Ney."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.treebank import treebank_tokens
from corpuslens.operators import kneser_ney as KN
from corpuslens.operators import lemmas as LM
from corpuslens.operators import sentences as SE
from corpuslens.sources import corpus as S
from corpuslens.sources.quoted_csv import read_quoted_csv


def test_treebank_conventions(spark):
    cases = {
        "they can't go, \"he said\" (U.S. style).": "they ca n't go , `` he said '' ( U.S. style ) .",
        "Gonna pay $3.50, or 1,000: cannot wait... really?": "Gon na pay $ 3.50 , or 1,000 : can not wait ... really ?",
        "I'll say it's \"fine\"--don't.": "I 'll say it 's `` fine '' -- do n't .",
        "the dogs' bones; a@b.c": "the dogs ' bones ; a @ b.c", "": "", "lemme [see]!": "lem me [ see ] !", "Prices: 5% & up": "Prices : 5 % & up",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: " ".join(r["x"]) for r in df.select("t", treebank_tokens(F.col("t")).alias("x")).collect()} == cases


def test_learnt_abbreviations_keep_sentences_whole(spark):
    texts = [f"Dr. Smith met Mr. Jones near point {k}. It was fine. They left! \"Why?\" nobody knew." for k in range(30)]
    texts += ["The end is near. A point was made here", None, "  ", *["who knew a fine day"] * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    learnt = SE.learn_abbreviations(docs)
    assert {r["word"] for r in learnt.collect()} >= {"dr", "mr"} and not {r["word"] for r in learnt.collect()} & {"fine", "near", "here"}
    got = {r["doc_id"]: r["sentences"] for r in SE.with_sentences(docs, learnt).collect()}
    assert got[3] == ["Dr. Smith met Mr. Jones near point 3.", "It was fine.", "They left!", "\"Why?\"", "nobody knew."]
    assert got[30] == ["The end is near.", "A point was made here"] and got[31] == got[32] == []
    tokens = {r["doc_id"]: r["tokens"] for r in SE.treebank_documents(docs, learnt).collect()}
    assert tokens[30] == "the end is near . a point was made here".split() and tokens[3][:3] == ["dr.", "smith", "met"]
    assert SE.with_sentences(docs.filter("false"), learnt).collect() == []


def test_lemmas_need_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "The dogs chased wolves, boxes; churches and glass"), (2, "dog wolf box church city cities women woman"), (2, "dogs"), (None, "wolves"), (3, None)],
                                 "doc_id int, text string")
    got = sorted(((r["doc_id"], r["norm"]) for r in LM.normalise_documents(docs).collect()), key=str)
    assert got == sorted([(1, "dog chased wolf box church glass"), (2, "dog wolf box church city city woman woman"), (2, "dog"), (None, "wolf"), (3, None)], key=str)
    own = spark.createDataFrame([("box",)], "word string")
    assert [r["norm"] for r in LM.normalise_documents(docs.filter("doc_id = 1"), vocabulary=own).collect()] == ["dogs chased wolves box churches glass"]
    assert LM.normalise_documents(docs.filter("doc_id = 1"), lemmas=False).first()["norm"] == "dogs chased wolves boxes churches glass"


def _csv_rows(seed, n):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choices(["a", "b ", "\n", '"', ",", "\r\n", "é", "long text ", "\n\n"], k=rng.randint(0, 12)))
    return [(str(k), cell(), cell()) for k in range(n)]


def _write_csv(path, rows):
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n\r') or not v else v
    path.write_bytes(("id,x,y\n" + "".join(",".join(map(quote, r)) + "\n" for r in rows)).encode())


@pytest.mark.parametrize("width", [64, 300, 1 << 20])
def test_quoted_csv_in_ranges(spark, tmp_path, width):
    files = [_csv_rows(1, 120), _csv_rows(2, 40), [], [("7", "one record " * 40 + "\n" * 300, "over many ranges")]]
    for k, rows in enumerate(files):
        _write_csv(tmp_path / f"f{k}.csv", rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    try:
        got = sorted((r["id"], r["x"] or "", r["y"] or "") for r in read_quoted_csv(spark, str(tmp_path)).collect())
        if width == 64:
            assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted(r for rows in files for r in rows)


def test_quoted_csv_schema_malformed_and_empty(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x\n1,"two\nlines"\n\n2,b,too many\n3\n4,d')
    rows = read_quoted_csv(spark, str(tmp_path / "a.csv"), "id int, x string")
    assert sorted((r["id"], r["x"]) for r in rows.collect()) == [(1, "two\nlines"), (2, "b"), (3, None), (4, "d")]
    kept = read_quoted_csv(spark, str(tmp_path / "a.csv"), "id int, x string", drop_malformed=True)
    assert sorted(r["id"] for r in kept.collect()) == [1, 4]
    (tmp_path / "b.csv").write_text("")
    assert read_quoted_csv(spark, str(tmp_path / "b.csv")).collect() == []


def test_a_repeated_append_leaves_its_rows_once(spark, tmp_path):
    out = str(tmp_path / "results")
    row = lambda v: spark.createDataFrame([("f1", v)], "metric string, value double")
    for run, v in (("r1", 0.1), ("r2", 0.2), ("r1", 0.3)):
        S.append_result(row(v), out, run)
    assert sorted((r["run_id"], r["value"]) for r in S.read_results(spark, out).collect()) == [("r1", 0.3), ("r2", 0.2)]
    with pytest.raises(ValueError):
        S.append_result(row(1.0), out, "../r")


def slow_kn(texts, d=0.75):
    """p(u, v, w) from plain counters."""
    tri = {}
    for t in texts:
        w = ["<s>", "<s>", *t.lower().split()]
        for g in zip(w, w[1:], w[2:]):
            tri[g] = tri.get(g, 0) + 1
    bi = {}
    for _, v, w in tri:
        bi[v, w] = bi.get((v, w), 0) + 1
    uni = {}
    for _, w in bi:
        uni[w] = uni.get(w, 0) + 1
    total = sum(uni.values())

    def p1(w):
        return max(uni.get(w, 0) - d, 0) / total + d * len(uni) / total / (len(uni) + 1)

    def p2(v, w):
        own = {x: k for (a, x), k in bi.items() if a == v}
        return max(own.get(w, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p1(w) if own else p1(w)

    def p3(u, v, w):
        own = {x: k for (a, b, x), k in tri.items() if (a, b) == (u, v)}
        return max(own.get(w, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * p2(v, w) if own else p2(v, w)
    return p3, set(uni)


def test_kneser_ney_probabilities(spark):
    texts = ["a b a b c", "a b d", "c a b a", "d d d a"]
    model = KN.fit_kneser_ney(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    slow, words = slow_kn(texts)
    contexts = [("<s>", "<s>"), ("a", "b"), ("b", "a"), ("d", "d"), ("c", "z"), ("z", "b"), ("z", "z")]
    rows = [(u, v, w) for (u, v), w in itertools.product(contexts, [*sorted(words), "<unk>"])]
    got = {(r["u"], r["v"], r["w"]): r["p"] for r in KN.with_probability(spark.createDataFrame(rows, "u string, v string, w string"), model).collect()}
    assert all(abs(got[k] - slow(*k)) < 1e-12 for k in rows)
    for u, v in contexts:
        assert abs(sum(got[u, v, w] for w in [*words, "<unk>"]) - 1) < 1e-12
    docs = spark.createDataFrame([(1, "a b z"), (2, ""), (3, None), (4, "A b a b a b")], "doc_id int, text string")
    ppl = {r["doc_id"]: r["ppl"] for r in KN.kneser_ney_perplexity(docs, model).collect()}
    w = ["<s>", "<s>", "a", "b", "z"]
    want = math.exp(-sum(math.log(slow(*g)) for g in zip(w, w[1:], w[2:])) / 3)
    assert set(ppl) == {1, 4} and abs(ppl[1] - want) < 1e-9 and ppl[4] < ppl[1]


def test_perplexities_count_in_place(spark):
    """The texts go to their documents once; lists of bigrams or trigrams are not shuffled by document first."""
    import re

    from corpuslens.operators import quality as Q
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b c"), (2, "b c d"), (3, None), (None, "a z")], "doc_id int, text string")
    bigram = Q.write_lm(Q.ngram_lm_fit(docs.filter("doc_id < 3")))
    scored = [Q.document_perplexity(docs, bigram, Q.lm_vocab_size(bigram)), KN.kneser_ney_perplexity(docs, KN.fit_kneser_ney(docs.filter("doc_id < 3")))]
    for found in scored:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(doc_id#\d+L?, [^\d]", plan) and re.search(r"hashpartitioning\(doc_id#\d+L?, \d+\)", plan)
        rows = {r["doc_id"]: r for r in found.collect()}
        assert {k: r["n_tokens"] for k, r in rows.items()} == {1: 4, 2: 5, None: 2}
    # p(a|<s>), p(b|a), p(a|b), p(b|a) with add-one over the five symbols <s>, a, b, c, d
    want = (2 / 8 * 3 / 7 * 2 / 8 * 3 / 7) ** -0.25
    assert abs({r["doc_id"]: r["ppl"] for r in scored[0].collect()}[1] - want) < 1e-9


def test_kneser_ney_by_blocks(spark, monkeypatch):
    """Many blocks and buckets give the plain counts' perplexities; no trigram is joined or shuffled by itself."""
    from corpuslens.operators import ngram_blocks as NB
    monkeypatch.setattr(NB, "LEAST_TOKENS", 5)
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("a b c dd".split()) for _ in range(rng.randint(1, 9)))
    real, syn = [(i, text()) for i in range(25)] + [(None, "a dd"), (99, None)], [(i // 2, text() + " z a") for i in range(9)] + [(9, "")]
    frames = [spark.createDataFrame(x, "doc_id int, text string").repartition(4) for x in (syn, real)]
    slow, _ = slow_kn([t for _, t in real if t])

    def mean(rows):
        sums = collections.defaultdict(list)
        for i, t in rows:
            w = ["<s>", "<s>", *(t or "").split()]
            sums[i] += [math.log(slow(*g)) for g in zip(w, w[1:], w[2:])]
        each = [math.exp(-sum(x) / len(x)) for x in sums.values() if x]
        return len(each), sum(each) / len(each)

    got = {r["corpus"]: (r["n_docs"], r["mean_perplexity"]) for r in KN.compare_perplexity(*frames).collect()}
    for name, rows in (("synthetic", syn), ("real", real)):
        assert got[name][0] == mean(rows)[0] and abs(got[name][1] - mean(rows)[1]) < 1e-9
    plan = KN.kneser_ney_perplexity(frames[0], KN.fit_kneser_ney(frames[1]))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(block" in plan
    empty = KN.compare_perplexity(frames[0], frames[1].filter("false")).collect()
    assert {r["corpus"]: (r["n_docs"], r["mean_perplexity"]) for r in empty} == {"synthetic": (5, 1.0), "real": (0, None)}


def test_bigram_scores_by_blocks(spark, monkeypatch):
    """Blocks and buckets of any number give the plain counts' perplexities; no bigram is joined or shuffled by itself."""
    from corpuslens.operators import ngram_blocks as NB
    from corpuslens.operators import quality as Q
    monkeypatch.setattr(NB, "LEAST_TOKENS", 5)
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("a b c dd ee F <s>".split()) for _ in range(rng.randint(0, 9)))
    real, syn = [(i // 2, text()) for i in range(30)] + [(None, "a a"), (99, None)], [(i, text() + " z") for i in range(12)] + [(3, "")]
    frames = [spark.createDataFrame(x, "doc_id int, text string").repartition(5) for x in (syn, real)]
    tokens = lambda t: ["<s>", *(t or "").lower().split()]
    pairs = collections.Counter(p for _, t in real for p in zip(tokens(t), tokens(t)[1:]))
    heads, size = collections.Counter(), len({w for _, w in pairs}) + 1
    for (v, _), n in pairs.items():
        heads[v] += n

    def mean(rows):
        sums = collections.defaultdict(list)
        for i, t in rows:
            sums[i] += [math.log((pairs[v, w] + 1) / (heads[v] + size)) for v, w in zip(tokens(t), tokens(t)[1:])]
        each = [math.exp(-sum(x) / len(x)) for x in sums.values() if x]
        return len(each), sum(each) / len(each)

    found = Q.corpus_perplexity(*frames)
    got = {r["corpus"]: (r["n_docs"], r["mean_perplexity"]) for r in found.collect()}
    for name, rows in (("synthetic", syn), ("real", real)):
        assert got[name][0] == mean(rows)[0] and abs(got[name][1] - mean(rows)[1]) < 1e-9
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(prev" not in plan and "hashpartitioning(block" in plan
    empty = Q.corpus_perplexity(frames[0], frames[1].filter("false")).collect()
    assert {r["corpus"]: r["n_docs"] for r in empty} == {"synthetic": 12, "real": 0}


def test_sentences_are_cut_where_the_texts_lie(spark, monkeypatch):
    """A short list of abbreviations goes to the texts, which are neither joined nor shuffled; a long one gives the same."""
    texts = ["Dr. Smith met Mr. Jones. He left.", "See fig. 3 and (fig. 4). Done", "tab\tfig. x\nfig.\u0085 y", "etc.. fig. end.\n", None, "fig. one"]
    docs = spark.createDataFrame(list(zip([1, 2, 2, None, 5, None], texts)), "doc_id int, text string")
    known = spark.createDataFrame([("dr",), ("mr",), ("fig",), (None,)], "word string")
    few = SE.with_sentences(docs, known)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    monkeypatch.setattr(SE, "FEW", 1)
    many = SE.with_sentences(docs, known)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert {r["text"]: r["sentences"] for r in few.collect()}[texts[0]] == ["Dr. Smith met Mr. Jones.", "He left."]


def test_skipped_treebank_rules_would_change_nothing(spark):
    from corpuslens.functions import treebank as TB
    rng = random.Random(4)
    parts = ["cannot", "Cannot", "CANNOT", "d'ye", "gimme", "gonna", "wanna", "lemme", "gotta", "more'n", "'tis", "'twas", "don't", "it's", "we'll", "a...b", "--", '"', "''", "'", ".", "?", ",", "x:y", "(", "]", "word", "é", "\n", "3.5"]
    rows = [("".join(rng.choice(parts) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 8))),) for _ in range(300)] + [(None,)]
    df = spark.createDataFrame(rows, "t string")
    plain = F.filter(F.split(TB._rewritten(F.col("t"), 0, len(TB.RULES)), r"\s+"), lambda t: t != F.lit(""))
    assert all(r["a"] == r["b"] for r in df.select(plain.alias("a"), treebank_tokens(F.col("t")).alias("b")).collect())
