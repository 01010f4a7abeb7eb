"""Dictionary entities, estimated Jaccard and variational topics."""

import random
import re

from pyspark.sql import functions as F

from corpuslens.operators import gazetteer as G
from corpuslens.operators import similarity as S
from corpuslens.operators import topics as TP

TOKEN = re.compile(r"\w+|[^\w\s]")


def slow_entities(text, dictionary):
    """Leftmost, then longest, token by token."""
    tokens = TOKEN.findall(text or "")
    known = {}
    for e, label in dictionary:
        t = tuple(TOKEN.findall(e))
        if t:
            known[t] = min(known.get(t, (e, label)), (e, label))
    out, i = [], 0
    while i < len(tokens):
        n = max((len(t) for t in known if tuple(tokens[i:i + len(t)]) == t), default=0)
        if n:
            out.append((i, n, *known[tuple(tokens[i:i + n])]))
        i += n or 1
    return out


def test_gazetteer_equals_token_scan(spark):
    rng = random.Random(3)
    words = ["New", "York", "of", "the", "City", "San", "José", "é", "Bank", ",", "AT&T", "U.S.", "北京"]
    for _ in range(3):
        dictionary = [(" ".join(rng.choices(words, k=rng.randint(1, 6))), rng.choice("AB")) for _ in range(25)]
        dictionary += [("", "x"), (" \t", "x"), dictionary[0], (dictionary[1][0].replace(" ", "  "), "Z")]
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(40)] + ["", None, " ".join(d[0] for d in dictionary[:8])]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
        got = G.gazetteer_entities(docs, spark.createDataFrame(dictionary, "entity string, label string")).collect()
        want = [(d, *h) for d, t in enumerate(texts) for h in slow_entities(t, dictionary)]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_gazetteer_long_phrases_and_empty_sides(spark):
    name = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x " + name + " w0 w1"), (2, name[:-1])], "doc_id int, text string")
    names = spark.createDataFrame([(name, "long"), ("w0 w1", "short"), ("w5 w6 w7", "inner")], "entity string, label string")
    got = sorted(tuple(r) for r in G.gazetteer_entities(docs, names).collect())
    assert got == [(1, 1, 30, name, "long"), (1, 31, 2, "w0 w1", "short"), (2, 0, 2, "w0 w1", "short"), (2, 5, 3, "w5 w6 w7", "inner")]
    assert G.gazetteer_entities(docs, names.filter("false")).collect() == []
    assert G.gazetteer_entities(docs.filter("false"), names).collect() == []
    plan = G.gazetteer_entities(docs, names)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_minhash_estimate_is_near_the_exact_mean(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(rng.sample(words, n))
    a = spark.createDataFrame([(i, text(30)) for i in range(30)] + [(98, ""), (99, None)], "doc_id int, text string")
    b = spark.createDataFrame([(i, text(25)) for i in range(30)] + [(98, " ")], "doc_id int, text string")
    exact = S.jaccard_mean(a.filter("text is not null"), b).first()[0]
    rows = a.filter("text is not null")
    assert abs(S.jaccard_minhash(rows, b, n_hashes=128).first()[0] - exact) < 0.02
    assert S.jaccard_minhash(a.filter("doc_id = 5"), a.filter("doc_id = 5")).first()[0] == 1.0
    assert S.jaccard_minhash(a.filter("doc_id >= 98"), b.filter("doc_id = 98")).first()[0] is None
    assert S.jaccard_minhash(a.filter("false"), b).first()[0] is None
    twice = rows.unionByName(rows)  # repeated rows count as often as they occur
    assert abs(S.jaccard_minhash(twice, b).first()[0] - S.jaccard_minhash(rows, b).first()[0]) < 1e-12


def test_topics_of_two_word_groups(spark):
    cooking, sailing = "butter flour onion pepper simmer".split(), "anchor harbour mast rudder sail".split()
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(cooking if i % 2 else sailing, k=20))) for i in range(40)] + [(98, ""), (99, None)]
    found = TP.fit_topics(spark.createDataFrame(docs, "doc_id int, text string"), k=2, passes=10)
    tops = {}
    for r in TP.top_terms(found, 5).collect():
        tops.setdefault(r["topic"], set()).add(r["term"])
    assert sorted(map(sorted, tops.values())) == sorted([cooking, sailing])
    shares = {(r["doc_id"], r["topic"]): r["p"] for r in TP.topic_shares(found).collect()}
    own = [max((0, 1), key=lambda t: shares[i, t]) for i in range(40)]
    assert len(shares) == 80 and len(set(own[::2])) == len(set(own[1::2])) == 1 and own[0] != own[1]
    assert all(max(shares[i, 0], shares[i, 1]) > 0.6 for i in range(40))
    probabilities = TP.term_probabilities(found).groupBy("topic").agg(F.sum("p_term_topic").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in probabilities)
    explorer = TP.topic_explorer(found, top_n=3).collect()
    assert len(explorer) == 6 and abs(sum({r["topic"]: r["topic_share"] for r in explorer}.values()) - 1) < 1e-9


def test_every_pass_reads_every_count(spark):
    """The mixtures hold each document's words: priors and counts add up exactly."""
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "plum pear"), (2, "quince")], "doc_id int, text string")
    found = TP.fit_topics(docs, k=2, passes=2)
    assert {r["doc_id"]: round(r["g0"] + r["g1"], 6) for r in found.mixtures.collect()} == {1: 4.0, 2: 4.0}
    assert round(sum(r["l0"] + r["l1"] for r in found.words.collect()), 6) == 6 + 4 * 1.0
    assert TP.top_terms(TP.fit_topics(docs.filter("false"), k=2, passes=1)).collect() == []


def test_digamma(spark):
    got = spark.createDataFrame([(1.0,), (0.5,), (10.0,), (1e6,)], "x double").select(TP.digamma(F.col("x"))).collect()
    want = (-0.5772156649, -1.9635100260, 2.2517525890, 13.8155100579)
    assert all(abs(g[0] - w) < 1e-7 for g, w in zip(got, want))


def test_hashed_embeddings_read_the_texts_once(spark):
    """Fits and scores read the written counts; the texts are not tokenised again."""
    from corpuslens.operators import models as MD
    docs = spark.createDataFrame([(i, f"alpha beta w{i % 5} gamma w{i % 3}") for i in range(30)], "doc_id int, text string")
    emb = MD.hashed_embeddings(docs, dims=3, num_features=64)
    assert emb.inputFiles() and all("hashed-counts" in f for f in emb.inputFiles())
    rows = emb.collect()
    assert len(rows) == 30 and all(len(r["embedding"]) == 3 for r in rows) and {"doc_id", "text"} <= set(emb.columns)


def _topic_steps(counts, k, passes, seed=7):
    """The same passes, count by count."""
    import hashlib

    import numpy as np
    terms, docs = sorted({t for _, t in counts}), sorted({d for d, _ in counts})
    start = lambda t, j: 1 + int(hashlib.md5(f"{seed}:{t}:{j}".encode()).hexdigest()[:8], 16) / (1 << 32)
    words = {t: np.array([start(t, j) for j in range(k)]) for t in terms}
    mixtures = {d: 1 / k + np.full(k, sum(n for (e, _), n in counts.items() if e == d) / k) for d in docs}
    psi = lambda x: TP.digamma(x, np.log)
    for _ in range(passes):
        total = sum(words.values())
        beta = {t: np.exp(psi(w) - psi(total)) for t, w in words.items()}
        for own, of in ((0, docs), (1, terms)):
            theta = {d: np.exp(psi(g) - psi(g.sum())) for d, g in mixtures.items()}
            new = {x: np.full(k, 1 / k) for x in of}
            for key, n in counts.items():
                p = theta[key[0]] * beta[key[1]]
                new[key[own]] += n * p / p.sum()
            mixtures, words = (new, words) if own == 0 else (mixtures, new)
    return words, mixtures


def test_passes_move_terms_instead_of_counts(spark, monkeypatch):
    """Counts lie in blocks that stay; the fit over several blocks and slices equals the fit count by count."""
    monkeypatch.setattr(TP, "BLOCK_COUNTS", 60)
    rng = random.Random(9)
    rows = [(d, rng.choices([f"word{chr(97 + i)}" for i in range(20)], k=30)) for d in range(30)]
    counts = {}
    for d, ws in rows:
        for w in ws:
            counts[d, w] = counts.get((d, w), 0) + 1
    docs = spark.createDataFrame([(d, " ".join(ws)) for d, ws in rows] + [(None, "worda wordz"), (50, None)], "doc_id int, text string")
    packed, terms, n_blocks = TP._blocks(TP.topic_counts(docs))
    assert n_blocks > 3 and packed.count() == n_blocks and terms.count() == 21
    got = TP.fit_topics(docs, k=2, passes=1)
    assert {r["term"] for r in got.words.collect()} == {t for _, t in counts}  # rows without an id have no mixture
    found = TP.fit_topics(docs.filter("doc_id is not null"), k=2, passes=2)
    words, mixtures = _topic_steps(counts, 2, 2)
    assert all(abs(r[f"l{t}"] - words[r["term"]][t]) < 1e-9 for r in found.words.collect() for t in range(2))
    assert {r["doc_id"] for r in found.mixtures.collect()} == set(mixtures)
    assert all(abs(r[f"g{t}"] - mixtures[r["doc_id"]][t]) < 1e-9 for r in found.mixtures.collect() for t in range(2))
