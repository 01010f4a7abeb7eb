import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate as D
from corpuslens.llm import queries as Q


def norm(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w):
    g = min(5, len(w))
    return [" ".join(w[i:i + g]) for i in range(len(w) - g + 1)]


def jaccard(a, b):
    a, b = Counter(grams(a)), Counter(grams(b))
    return sum((a & b).values()) / sum((a | b).values())


def brute(docs, items, threshold=0.8):
    """All windows of all documents against all items, without fingerprints."""
    out = {}
    for i, it in items:
        v = norm(it)
        if not v:
            continue
        for d, t in docs:
            w = norm(t)
            if not set(grams(v)) & set(grams(w)) and min(len(v), len(w)) >= 5:
                continue
            for s in range(max(1, len(w) - len(v) + 1)):
                if w and (x := jaccard(w[s:s + len(v)], v)) >= threshold:
                    out[d, i] = max(out.get((d, i), 0), x)
    return out


def got(df):
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in df.collect()}


def make(rng):
    vocab = [f"{a}{b}" for a in "bcdfghklmn" for b in ("o", "ar", "ist", "é")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(12, 60))) for i in range(25)] + [(50, "tiny item"), (51, ""), (52, None), (53, "... !"), (54, "w " * 30)]
    docs = []
    for k in range(120):
        i, it = rng.choice(items[:25])
        w = it.split()
        way = k % 6
        if way == 1:
            w[rng.randrange(len(w))] = "changed"
        elif way == 2:
            w = w[: len(w) - rng.randrange(1, 8)]
        elif way == 3:
            w[0], w[-1] = "x", "y"
        elif way == 4:
            w = text(len(w)).split()
        docs.append((k, " ".join([text(rng.randrange(0, 40)), *([" ".join(w).upper() + ",;"] if way == 5 else w), text(rng.randrange(0, 40))])))
    docs += [(200, None), (201, ""), (202, items[0][1]), (203, " ".join(items[1][1].split()[:-1])), (204, "a tiny item here"), (205, text(30_000) + " " + items[2][1]), (206, "w " * 500),
             (None, items[3][1]), (7, docs[7][1]), (7, items[4][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = make(random.Random(11))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("item_id", F.lit("x"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert got(D.contaminated(d, b)) == want
    assert got(D.contaminated(d, b, broadcast_rows=0)) == want
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def test_simhash_and_blocks(spark):
    import xxhash
    rng = random.Random(3)
    ws = [[f"w{rng.randrange(20)}" for _ in range(n)] for n in (1, 2, 3, 40, 400)]
    out = spark.createDataFrame([(w,) for w in ws], "w array<string>").transform(D.with_simhash).collect()
    for r in out:
        hs = [xxhash.xxh64_intdigest(x, 42) for x in r.w]
        assert r.fp % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    pairs = []
    for _ in range(300):
        a, b = rng.getrandbits(64), 0
        for x in rng.sample(range(64), rng.randrange(0, 16)):
            b |= 1 << x
        pairs.append(tuple(v - 2**64 if v >= 2**63 else v for v in (a, a ^ b)))
    df = spark.createDataFrame(pairs, "a long, b long").select(F.arrays_overlap(D.block_values(F.col("a"), 4, 3), D.block_values(F.col("b"), 4)).alias("met"))
    assert df.filter("not met").count() == 0


def test_query_on_table(spark, sf):
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").select(*{"documents": ("doc_id", "text"), "benchmark": ("item_id", "text")}[t]).collect()
    assert got(Q.QUERIES["op10_decontaminate"](spark, sf)) == {k: round(v, 9) for k, v in brute(read("documents"), read("benchmark")).items()}


def test_plan_is_native(spark, sf):
    plan = Q.QUERIES["op10_decontaminate"](spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_phrase_that_all_share_pairs_nothing(spark):
    rng = random.Random(9)
    phrase = "please answer the following question now"
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(24))
    items = [(k, f"{phrase} {text()}") for k in range(300)]
    docs = [(k, f"{text()} {phrase} {text()}") for k in range(296)] + [(900 + k, "start " + items[k][1] + " end") for k in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    prepared = D.prepare_items(bench, "item_id", "text", 5, 0.8)
    texts = corpus.select("doc_id", F.xxhash64("text").alias("key"), D.words(F.col("text")).alias("w"))
    assert D._anchors(texts, prepared, 10 ** 6).count() <= 4 * 300  # 180 000 pairs share the phrase
    assert set(got(D.contaminated(corpus, bench))) == {(900 + k, k) for k in range(4)}


def test_short_documents_and_items_that_repeat_an_id(spark):
    words = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(words)), (1, " ".join(words[::-1])), (None, " ".join(words[5:35]))]
    docs = [(1, " ".join(words[:37])), (2, " ".join(words[3:])), (3, " ".join(words[::-1])), (4, " ".join(words[:20])), (5, " ".join(words[5:35]))]
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    held = {(r.doc_id, r.item_id) for r in found.collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, None)} <= held and not any(d == 4 for d, _ in held)
