import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuslens.operators import descriptive as D
from corpuslens.operators import similarity as S

T1 = ["This is a short sentence.", "Here is another one.", "This one is a bit longer than the others."]
T2 = ["This is the first text.", "Here comes the second.",
      "The third text is somewhat longer compared to the first two."]


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_length_comparison(spark):
    rows = {r.metric: r for r in D.length_comparison(_docs(spark, T1), _docs(spark, T2)).collect()}
    assert rows["avg_len"].syn == 6 and abs(rows["avg_len"].ref - 20 / 3) < 1e-9
    assert rows["min_len"].syn == 4 and rows["max_len"].ref == 11
    assert abs(rows["avg_unique"].ref - 20 / 3) < 1e-9


def test_fixture_similarities(spark):
    res = {r.metric: r.value for r in S.compare_corpora(_docs(spark, T1), _docs(spark, T2)).collect()}
    assert abs(res["jaccard"] - 0.132054) < 1e-6
    assert abs(res["cosine"] - 0.279562) < 1e-6
    assert math.isinf(res["kl_divergence"])


def test_vocabulary(spark):
    _, _, idf = S.tfidf(_docs(spark, T1))
    assert sorted(r.term for r in idf.collect()) == [
        "another", "bit", "here", "is", "longer", "one", "others", "sentence", "short", "than", "the", "this"]


def _dense(spark, rows, vocab):
    idx = {t: i for i, t in enumerate(vocab)}
    ids = sorted({r.doc_id for r in rows})
    m = np.zeros((len(ids), len(vocab)))
    pos = {d: i for i, d in enumerate(ids)}
    for r in rows:
        m[pos[r.doc_id], idx[r.term]] = r.x
    return m


def test_separable_identities_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    syn = docs.filter(F.col("doc_id") % 2 == 0).select("doc_id", "text")
    ref = docs.filter(F.col("doc_id") % 2 == 1).select("doc_id", "text")
    x, y, idf = S.tfidf(syn, ref)
    vocab = sorted(r.term for r in idf.collect())
    X, Y = _dense(spark, x.collect(), vocab), _dense(spark, y.collect(), vocab)
    n1, n2 = syn.count(), ref.count()
    # rows without terms are zero rows (still counted)
    brute_cos = (X @ Y.T).sum() / (n1 * n2)
    n1f = syn.agg(F.count("*").alias("n"))
    n2f = ref.agg(F.count("*").alias("n"))
    got = S.cosine_mean(x, y, n1f, n2f).first().cosine
    assert abs(got - brute_cos) < 1e-9
    # KL on a subset where every ref row holds every fitted term: make Y dense positive
    Xs, Ys = X[:5] + 0.0, np.abs(Y[:4]) + 0.01
    kl = []
    for a in Xs:
        for b in Ys:
            kl.append(np.sum(np.where(a > 0, a * np.log(np.where(a > 0, a, 1) / b), 0) - a + b))
    brute_kl = float(np.mean(kl))
    rows_x = [(i, vocab[t], float(Xs[i, t])) for i in range(Xs.shape[0]) for t in range(len(vocab)) if Xs[i, t] > 0]
    rows_y = [(j, vocab[t], float(Ys[j, t])) for j in range(Ys.shape[0]) for t in range(len(vocab))]
    xf = spark.createDataFrame(rows_x, "doc_id long, term string, x double")
    yf = spark.createDataFrame(rows_y, "doc_id long, term string, x double")
    got_kl = S.kl_mean(xf, yf, idf, spark.createDataFrame([(5,)], "n long"),
                       spark.createDataFrame([(4,)], "n long"), with_inf_share=True).first()
    assert abs(got_kl.kl - brute_kl) < 1e-6 * max(1, abs(brute_kl))
    assert got_kl.inf_pair_share == 0


def test_jaccard_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    syn = docs.filter(F.col("doc_id") % 3 == 0).select("doc_id", "text")
    ref = docs.filter(F.col("doc_id") % 3 != 0).select("doc_id", "text")
    a = [set(r.text.split()) for r in syn.collect()]
    b = [set(r.text.split()) for r in ref.collect()]
    brute = np.mean([len(p & q) / len(p | q) for p in a for q in b])
    got = S.jaccard_mean(syn, ref).first().jaccard
    assert abs(got - brute) < 1e-9
    got_join = S.jaccard_mean(syn, ref, left_rows=7, right_rows=5).first().jaccard
    assert abs(got_join - brute) < 1e-9


def test_entity_report_ties(spark):
    texts = ["Alice Brown met Carl Dunn.", "Carl Dunn and Eve Fox.", "Gus Hill, Eve Fox, Ivy Jones."]
    m = D.extract_entities(_docs(spark, texts))
    counts = D.entity_counts(m)
    top = [r.entity for r in D.top_entities(counts, 2).orderBy("rank").collect()]
    assert top == ["Carl Dunn", "Eve Fox"]
    least = [r.entity for r in D.least_entities(counts, 2).orderBy("rank").collect()]
    assert least == ["Alice Brown", "Gus Hill"]


def test_ngram_extremes(spark):
    texts = ["a b a b c", "c d"]
    counts = D.ngram_counts(_docs(spark, texts), 2, tokens=F.split("text", " "))
    rows = {(r.kind, r["rank"]): (r.ngram, r.cnt) for r in D.ngram_extremes(counts, 2).collect()}
    assert rows[("most", 1)] == ("a b", 2)
    assert rows[("least", 1)] == ("c d", 1)


def test_jaccard_blocks_are_few(spark):
    """Each block goes to every block of the other side: large corpora need few of them."""
    sets = spark.range(300_000).select(F.lit(100).alias("k"))
    sides = int((4 * spark.sparkContext.defaultParallelism) ** 0.5) + 1
    assert -(-300_000 // S._block_rows(sets, S.BLOCK_ROWS)) <= max(sides, 5)
    assert S._block_rows(sets.limit(10), S.BLOCK_ROWS) >= 10 and S._block_rows(sets.filter("false"), 7) >= 1


def test_jaccard_blocks_are_shuffled_once(spark):
    """A block is one row that every tile reads where it lies; it is not copied for each block of the other side."""
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(i % 6)) for i in range(40)]
    found = S.jaccard_mean(_docs(spark, texts[:25]), _docs(spark, texts[15:]), left_rows=4, right_rows=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "CoGroup" not in plan and plan.count("Exchange rangepartitioning(block") == 2
    sets = [set(t.split()) for t in texts]
    pairs = [len(p & q) / len(p | q) for p in sets[:25] for q in sets[15:] if p | q]
    assert abs(found.first().jaccard - np.mean(pairs)) < 1e-12


def test_jaccard_frequent_and_rare_words(spark, monkeypatch):
    """Words counted by matrices, by the index, and across several slices give the brute-force mean."""
    rng = np.random.default_rng(3)
    text = lambda: " ".join([f"common{i}" for i in range(5) if rng.random() < 0.7] + [f"rare{i}" for i in rng.integers(0, 400, 12)])
    a, b = [text() for _ in range(60)] + [""], [text() for _ in range(50)] + [""]
    sets = [[set(t.split()) for t in side] for side in (a, b)]
    pairs = [len(p & q) / len(p | q) for p in sets[0] for q in sets[1] if p | q]
    t = lambda side: pa.table({"k": pa.array([len(s) for s in side], pa.int32()), "h": pa.array([[hash(w) for w in s] for s in side], pa.list_(pa.int64()))})
    monkeypatch.setattr(S, "CELLS", 300)
    assert abs(S._jaccard_tile(t(sets[0]), t(sets[1]))["num"][0].as_py() - sum(pairs)) < 1e-9
    assert abs(S.jaccard_mean(_docs(spark, a), _docs(spark, b)).first().jaccard - np.mean(pairs)) < 1e-9


def test_term_counts_shuffle_texts_alone(spark, sf):
    """One exchange, of the texts by id: the lists of terms are counted where they are."""
    plan = S.term_counts(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "hashpartitioning(doc_id#0L, term" not in plan
    assert plan.index("Exchange hashpartitioning") > plan.index("Generate explode")  # printed from the top: the terms come after the exchange
    twice = spark.createDataFrame([(1, "pear plum"), (1, "pear"), (None, "plum"), (None, "plum fig")], "doc_id int, text string")
    assert sorted(map(tuple, S.term_counts(twice).collect()), key=str) == sorted([(1, "pear", 2), (1, "plum", 1), (None, "plum", 2), (None, "fig", 1)], key=str)


def test_infinite_share_of_few_term_sets(spark):
    """Documents of equal term sets meet as classes: 4 million pairs of one class are one pair."""
    terms = F.explode(F.array(*[F.lit(t) for t in ("fig", "pear", "plum")])).alias("term")
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), terms, F.lit(0.5).alias("x"))
    one = spark.createDataFrame([(2000,)], "n long")
    assert S._term_classes(rows, "i").count() == 1
    assert S._kl_inf_share(rows, rows, one, one).first()[0] == 0


def test_infinite_share_brute_force(spark):
    rng = np.random.default_rng(11)
    sides = [[sorted({f"t{t}" for t in rng.zipf(1.6, rng.integers(1, size)) if t < 60}) for _ in range(n)] for size, n in ((6, 80), (40, 70))]
    frames = [spark.createDataFrame([(i, t, 1.0) for i, s in enumerate(side) for t in s], "doc_id long, term string, x double") for side in sides]
    n1, n2 = (spark.createDataFrame([(len(s),)], "n long") for s in sides)
    want = np.mean([not set(p) <= set(q) for p in sides[0] for q in sides[1]])
    assert {min(len(p), 4) for p in sides[0]} >= {1, 2, 3}
    assert abs(S._kl_inf_share(*frames, n1, n2).first()[0] - want) < 1e-12


def test_ngrams_are_counted_before_they_are_grouped_as_texts(spark):
    """Any n, repeated and null ids, null tokens: one row an n-gram of the chunk, as exploded rows give."""
    rows = [(3, ["a", "b", "a", "b", None, "c"]), (1, ["b", "a", "b"]), (1, ["x", "a", "b"]), (None, ["a", "b c"]), (2, []), (4, None), (5, ["a b", "c"]), (1, ["a", "b"])]
    for kind in ("int", "string", "double"):
        docs = spark.createDataFrame([(None if i is None else {"int": int, "string": str, "double": float}[kind](i), t) for i, t in rows], f"doc_id {kind}, t array<string>").coalesce(1)
        for n in (1, 2, 3):
            want = {}
            for i, t in rows:
                for p in range(len(t or []) - n + 1):
                    g = t[p] if n == 1 else " ".join(x for x in t[p:p + n] if x is not None)
                    c, first = want.get(g, (0, ((True, 9), 9)))
                    want[g] = c + 1, min(first, ((i is not None, i or 0), p))
            got = D.ngram_counts(docs, n, tokens=F.col("t"))
            assert {r["ngram"]: (r["cnt"], r["first_doc"] is not None, float(r["first_doc"] or 0), r["first_pos"]) for r in got.collect()} == {g: (c, f[0][0], f[0][1], f[1]) for g, (c, f) in want.items()}
    plan = D.ngram_counts(docs.select(F.col("doc_id").cast("int").alias("doc_id"), "t"), 2, tokens=F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
