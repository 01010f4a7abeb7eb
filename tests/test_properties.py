import random
import re

from corpuslens.operators import search

ALPHABET = list("abcAB .-()+*?[]\\\"'é") + ["  ", "\n"]


def _rand_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_random_entities_match_python_re(spark):
    rng = random.Random(11)
    texts = [_rand_text(rng, rng.randint(0, 60)) for _ in range(40)]
    ents = []
    for _ in range(40):
        t = rng.choice(texts)
        if t and rng.random() < 0.7:
            i = rng.randint(0, len(t) - 1)
            ents.append(t[i:i + rng.randint(1, 8)])
        else:
            ents.append(_rand_text(rng, rng.randint(1, 6)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    es = spark.createDataFrame(list(enumerate(ents)), "entity_id long, entity string")
    got = {(r.doc_id, r.entity_id) for r in search.entity_mentions(docs, es).collect()}
    got0 = {(r.doc_id, r.entity_id) for r in search.entity_mentions(docs, es).collect()}
    exp = set()
    for i, t in enumerate(texts):
        for j, e in enumerate(ents):
            if re.search(r"\b" + re.escape(e.strip('"')) + r"\b", t, re.IGNORECASE):
                exp.add((i, j))
    assert got == exp == got0


def test_random_phrases_match_python(spark):
    rng = random.Random(5)
    words = ["a", "b", "ab", "a.b", "(x)", "x+"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 15))) for _ in range(30)]
    ents = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(15)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    es = spark.createDataFrame(list(enumerate(ents)), "entity_id long, entity string")
    got = sorted((r.entity, r.phrase, r.context_len) for r in search.context_phrases(docs, es, window=2).collect())
    exp = []
    for t in texts:
        for p in ents:
            pat = re.compile(r"((?:\S+\s+){0,2})%s((?:\s+\S+){0,2})" % re.escape(p))
            for m in pat.finditer(t):
                w = m.group(0).strip().split()
                n = len(w)
                for k in range(2):
                    s = " ".join(w[k:n - k]).strip()
                    if p in s:
                        exp.append((p, s, 2 - k))
    assert got == sorted(exp)
    found = {r.phrase for r in search.phrases_found_in(
        spark.createDataFrame([(p,) for _, p, _ in exp] + [("zz",)], "phrase string"), docs).collect()}
    assert found == {p for _, p, _ in exp if any(p in t for t in texts)}
