import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpuslens.llm import simhash_dedup as S
from corpuslens.llm import queries as Q


def slow_fingerprint(text):
    import re
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(fps, d):
    parent = list(range(len(fps)))
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_equals_definition():
    texts = ["", None, " \t\n", "One", "One two", "One two three", "a b c d e f a b c", "É x y Z z\x0bq\x1cr " * 7, "w " * 9000]
    assert [S.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_spark_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("a b c", 42)


def clustered(rng, n):
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        out.add(base)
        for _ in range(rng.randrange(6)):
            x = base
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
            base = x if rng.random() < 0.5 else base
    return sorted(out)


def test_forest_equals_brute_force():
    rng = random.Random(7)
    for n in (1, 2, 50, 400):
        xs = clustered(rng, n)
        arr = np.array(xs, np.uint64)
        for d in (0, 2, 3):
            parent = list(range(len(xs)))
            def find(i):
                while parent[i] != i:
                    i = parent[i]
                return i
            for i, j in S.forest(arr, None, d):
                assert (xs[i] ^ xs[j]).bit_count() <= d
                parent[find(i)] = find(j)
            want = slow_components(xs, d)
            got = [find(i) for i in range(len(xs))]
            assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def check_links(spark, xs, max_members, step_hot):
    fps = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in xs], "fp long")
    pairs = S.node_pairs(fps, 2, max_members=max_members, step=step_hot)
    roots = {r.node: r.root for r in S.components(S.links(pairs, 2)).collect()}
    signed = [x - 2**64 if x >= 2**63 else x for x in xs]
    want = slow_components(xs, 2)
    got = [roots.get(x, x) for x in signed]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_trie_join_and_components_equal_brute_force(spark):
    check_links(spark, clustered(random.Random(3), 300), 4096, 8)


def test_hot_nodes_are_descended_without_loss(spark):
    rng = random.Random(5)
    xs = clustered(rng, 60) + [0b111 << 40 | 1 << b for b in range(40)] + [rng.getrandbits(20) for _ in range(150)]
    check_links(spark, sorted(set(xs)), 8, 8)


def test_groups_on_hard_rows(spark):
    base = " ".join(f"word{i}" for i in range(200))
    rows = [(5, base), (3, base), (9, base + " tail"), (1, None), (2, ""), (4, " \n"), (7, "alone here"), (7, "alone here"), (None, base), (6, "x " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_groups(df).collect()]
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = slow_components(fps, 2)
    want = [(i, f"{f:016x}", min(j for (j, _), c2 in zip(rows, comp) if c2 == c and j is not None)) for (i, _), f, c in zip(rows, fps, comp)]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert S.simhash_groups(df.limit(0)).count() == 0


def test_query_equals_brute_force_on_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    comp = slow_components(fps, 2)
    least = {}
    for r, c in zip(docs, comp):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {r.doc_id: (f"{f:016x}", least[c]) for r, f, c in zip(docs, fps, comp)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in Q.QUERIES["op4_simhash_dedup"](spark, sf).collect()}
    assert got == want
