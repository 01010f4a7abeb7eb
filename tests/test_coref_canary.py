import itertools
import math

import numpy as np
import pytest

from corpuslens.operators import canary as K
from corpuslens.operators import coref as CO


def _mentions(spark, rows):
    return spark.createDataFrame(rows, "doc_key string, cluster string, start int, end int")


def test_identity_scores_one(spark):
    gold = _mentions(spark, [("d", "a", 0, 0), ("d", "a", 2, 2), ("d", "b", 3, 4), ("d", "b", 6, 6),
                             ("e", "x", 1, 1), ("e", "x", 5, 5)])
    s = {r.metric: r for r in CO.coref_scores(gold, gold, with_lea=True).collect()}
    for m in ("muc", "b_cubed", "ceafe", "lea", "avg"):
        assert abs(s[m].f1 - 1.0) < 1e-12


def test_ceafe_singletons(spark):
    gold = _mentions(spark, [("d", "a", 0, 0), ("d", "a", 1, 1), ("d", "s", 5, 5)])
    s = {r.metric: r for r in CO.coref_scores(gold, gold).collect()}
    assert abs(s["ceafe"].precision - 1.0) < 1e-12 and abs(s["ceafe"].recall - 0.5) < 1e-12


def best_assignment(w):
    """Greatest weight over all injective maps of the smaller side."""
    small, large = (w, w.T)[w.shape[0] > w.shape[1]], None
    large = small.shape[1]
    return max(sum(small[i, j] for i, j in enumerate(perm)) for perm in itertools.permutations(range(large), small.shape[0]))


def test_sparse_assignment_matches_brute_force():
    rng = np.random.default_rng(3)
    for r, c in [(3, 3), (2, 4), (4, 2), (5, 5), (1, 6), (6, 5)] * 6:
        w = np.where(rng.random((r, c)) < 0.6, rng.integers(1, 9, (r, c)) / 8, 0)
        edges = [(i, j, w[i, j]) for i in range(r) for j in range(c) if w[i, j]]
        assert abs(CO.sparse_assignment(edges) - best_assignment(w)) < 1e-9


def dense_assignment(w):
    """Best assignment of a square matrix by Bellman-Ford augmentation over all cells."""
    n = len(w)
    owner, col = [-1] * n, [-1] * n
    for _ in range(n):
        dist, came = [-math.inf] * n, [None] * n  # best gain of reaching a column
        gain = {i: 0.0 for i in range(n) if col[i] < 0}
        for _ in range(n + 1):
            moved = False
            for i, g in list(gain.items()):
                for j in range(n):
                    new = g + w[i][j]
                    if j != col[i] and new > dist[j] + 1e-12:
                        dist[j], came[j], moved = new, i, True
                        if owner[j] >= 0 and new - w[owner[j]][j] > gain.get(owner[j], -math.inf) + 1e-12:
                            gain[owner[j]] = new - w[owner[j]][j]
            if not moved:
                break
        end = max((j for j in range(n) if owner[j] < 0), key=lambda j: dist[j])
        while end >= 0:
            i = came[end]
            owner[end], col[i], end = i, end, col[i]
    return sum(w[i][col[i]] for i in range(n))


@pytest.mark.parametrize("together", [1000, 50])
def test_ceafe_of_two_hundred_clusters_in_a_document(spark, monkeypatch, together):
    monkeypatch.setattr(CO, "MOST_TOGETHER", together)
    rng = np.random.default_rng(8)
    rows = [(int(x), int(rng.integers(0, 200)), int(rng.integers(0, 200))) for x in range(700)]
    gold = _mentions(spark, [("d", f"c{g}", x, x) for x, g, _ in rows] + [("e", "c1", 0, 0), ("e", "c1", 1, 1)])
    pred = _mentions(spark, [("d", f"k{p}", x, x) for x, _, p in rows] + [("e", "k1", 0, 0), ("e", "k1", 1, 1)])
    gs, ps = np.bincount([g for _, g, _ in rows], minlength=200), np.bincount([p for _, _, p in rows], minlength=200)
    w = np.zeros((200, 200))
    for _, g, p in rows:
        if ps[p] > 1:
            w[g, p] += 2 / (gs[g] + ps[p])
    want = dense_assignment(w.tolist()) + 1
    got = CO.ceafe_counts(pred, gold).first()
    assert abs(got.p_num - want) < 1e-9 and (got.p_den, got.r_den) == ((ps > 1).sum() + 1, (gs > 0).sum() + 1)


def test_components_of_paths_and_rings(spark):
    from corpuslens.operators.components import component_roots
    rows = [("a", k, k + 1) for k in range(40)] + [("a", 100, 60), ("b", 5, 9), ("b", 9, 5), ("b", 3, 3)] + [("c", k, (k + 1) % 7) for k in range(7)]
    got = {(r.key, r.node): r.root for r in component_roots(spark.createDataFrame(rows, "key string, u long, v long"), "key").collect()}
    assert got == {**{("a", k): 0 for k in range(41)}, ("a", 100): 60, ("a", 60): 60, ("b", 5): 5, ("b", 9): 5, **{("c", k): 0 for k in range(7)}}


def test_scores_without_predictions_are_zero(spark):
    gold = _mentions(spark, [("d", "a", 0, 0), ("d", "a", 1, 1), ("d", "b", 2, 2)])
    none = gold.filter("false")
    for pred, ref in ((none, gold), (gold, none), (none, none)):
        assert {(r.precision, r.recall, r.f1) for r in CO.coref_scores(pred, ref, with_lea=True).collect()} == {(0.0, 0.0, 0.0)}


def test_muc_hand_case(spark):
    gold = _mentions(spark, [("d", "g1", 0, 0), ("d", "g1", 1, 1), ("d", "g1", 2, 2)])
    pred = _mentions(spark, [("d", "p1", 0, 0), ("d", "p1", 1, 1), ("d", "p2", 2, 2), ("d", "p2", 9, 9)])
    p = CO.muc_counts(pred, gold).first()
    r = CO.muc_counts(gold, pred).first()
    assert (p.num, p.den) == (1.0, 2.0)   # p1: 2-0-1 ; p2: 2-1-1
    assert (r.num, r.den) == (1.0, 2.0)   # g1: 3-0-2


def test_link_clusters(spark):
    links = spark.createDataFrame([("d", 2, 1), ("d", 3, 2), ("d", 7, 3), ("d", 5, 4), ("e", 9, 8)],
                                  "doc_key string, mention int, antecedent int")
    got = {(r.doc_key, r.mention): r.root for r in CO.clusters_from_links(links).collect()}
    assert got[("d", 7)] == 1 and got[("d", 5)] == 4 and got[("e", 9)] == 8 and got[("d", 1)] == 1


def test_canary_lines_and_exposure(spark):
    lines = spark.createDataFrame([("  Alex went out. || Alex || name ",), ("bad || line",),
                                   ("Call 123-342-900 now. || 123-342-900 || number",)], "value string")
    specs = K.parse_canary_lines(lines)
    assert specs.count() == 2
    cands = K.generate_candidates(specs, 4)
    assert cands.count() == 8
    assert all("Alex" not in r.candidate or r.subject != "Alex" for r in cands.collect())

    def by_length(df):   # canary is the longest -> last rank; or shortest
        from pyspark.sql import functions as F
        return df.withColumn("ppl", F.when(F.col("text") == "Alex went out.", F.lit(0.0))
                             .otherwise(F.length("text").cast("double") + 1))
    out = {r.subject: r for r in K.canary_exposure(cands, specs, by_length).collect()}
    assert out["Alex"].rank == 1 and abs(out["Alex"].exposure - 2.0) < 1e-12

    def worst(df):
        from pyspark.sql import functions as F
        return df.withColumn("ppl", F.when(F.col("text").contains("Alex"), F.lit(1e9)).otherwise(F.lit(1.0)))
    out = {r.subject: r for r in K.canary_exposure(cands, specs, worst).collect()}
    assert out["Alex"].rank == 5 and abs(out["Alex"].exposure - math.log2(4 / 5)) < 1e-12


def test_unknown_canary_type_raises(spark):
    import pytest
    specs = spark.createDataFrame([("x y", "y", "planet")], "sentence string, secret string, type string")
    with pytest.raises(Exception):
        K.generate_candidates(specs, 2).collect()


def test_insertion(spark):
    data = spark.createDataFrame([(i, f"First {i}. Second {i}.") for i in range(6)] + [(6, "no period")],
                                 "doc_id long, text string")
    specs = spark.createDataFrame([("CANARY ONE", "ONE", "name")], "sentence string, secret string, type string")
    out = K.insert_canaries(data, specs, copies=3).collect()
    marked = [r for r in out if r.canary != "no_canary"]
    assert len(marked) == 3 and all("CANARY ONE" in r.text for r in marked)
    assert all(r.doc_id != 6 for r in marked)
    for r in marked:
        assert r.text.replace(" CANARY ONE", "", 1) in {f"First {r.doc_id}. Second {r.doc_id}."}
