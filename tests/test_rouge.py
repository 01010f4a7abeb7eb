import itertools
import random

import pytest

from corpuslens.functions.porter import with_stems
from corpuslens.operators import rouge as R

#: Examples of the published description of the algorithm, taken through all steps.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled",
    "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
    "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit", "conformabli": "conform", "radicalli": "radic", "differentli": "differ",
    "vileli": "vile", "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis",
    "hopefulness": "hope", "callousness": "callous", "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust", "defensible": "defens", "irritant": "irrit",
    "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun", "activate": "activ",
    "angulariti": "angular", "homologous": "homolog", "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "toy": "toi", "syzygy": "syzygi", "by": "by", "is": "is",
}


def test_porter_stems(spark):
    words = spark.createDataFrame([(w,) for w in STEMS], "word string")
    assert {r["word"]: r["stem"] for r in with_stems(words, "word").collect()} == STEMS


def subsequences(a, b):
    """Length of the longest common subsequence by trying all of the shorter side's."""
    for n in range(len(a), 0, -1):
        for picks in itertools.combinations(range(len(a)), n):
            it = iter(b)
            if all(a[i] in it for i in picks):
                return n
    return 0


def test_common_subsequences_match_brute_force():
    rng = random.Random(4)
    for _ in range(120):
        a, b = (rng.choices("abc", k=rng.randint(0, 7)) for _ in range(2))
        n = subsequences(a, b)
        places = sorted(R.lcs_places(a, b))
        it = iter(b)
        assert R.lcs_length(a, b) == n == len(places) and all(a[i] in it for i in places)


def test_union_over_sentences():
    ref, pred = ["w1 w2 w3 w4 w5".split()], ["w1 w2 w6 w7 w8".split(), "w1 w3 w8 w9 w5".split()]
    assert R.union_hits(pred, ref) == 4  # w1 w2 and w1 w3 w5: four different words of five
    assert R.pair_scores(pred, ref)["rougeLsum"] == {"p": 0.4, "r": 0.8}
    assert R.union_hits([], ref) == R.union_hits(pred, []) == 0
    assert R.union_hits([["a"], ["a"]], [["a", "a"]]) == 1  # both sentences meet the same place


def test_repeated_ids_nulls_and_summary(spark):
    rows = [(1, "The cat sat.\nIt purred", "the cat sat"), (1, "a a b", "a b b"), (2, None, "x"), (3, "", ""), (4, "running dogs", "dog run")]
    pairs = spark.createDataFrame(rows, "id int, prediction string, reference string")
    got = sorted((r["id"], round(r["precision"], 6), round(r["recall"], 6)) for r in R.rouge_n(pairs, 1).collect())
    assert got == [(1, 0.6, 1.0), (1, 0.666667, 0.666667), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 0.0, 0.0)]
    stemmed = {r["id"]: r["fmeasure"] for r in R.rouge_n(pairs.filter("id = 4"), 1, stem=True).collect()}
    assert stemmed == {4: 1.0}  # run is short and stays, running becomes run
    assert [r["fmeasure"] for r in R.rouge_lsum(pairs.filter("id = 3")).collect()] == [0.0]
    assert {r["metric"] for r in R.rouge_summary(pairs).collect()} == {"rouge1", "rouge2", "rougeL", "rougeLsum"}
    assert R.rouge_summary(pairs.filter("false")).collect() == []
    with pytest.raises(ValueError):
        R.rouge_n(pairs, 3)
    plan = R.rouge_n(pairs, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
