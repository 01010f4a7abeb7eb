"""ROUGE-N, ROUGE-L and ROUGE-Lsum of (prediction, reference) pairs.

Every score is computed in its own row, in Arrow batches: no shuffle, and rows
that share an id stay separate. With ``stem`` the distinct words of more than
three letters are stemmed once by :mod:`porter` and joined back as a map from
word to stem.

A null prediction or reference counts as empty; empty sides score 0.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.porter import with_stems
from ..session import materialise

NAMES = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def rouge_tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != F.lit(""))


def sentence_tokens(text: Column) -> Column:
    """The tokens of each line (ROUGE-Lsum takes a text's lines as its sentences)."""
    return F.filter(F.transform(F.split(text, "\n"), rouge_tokens), lambda s: F.size(s) > 0)


def ngram_overlap(a: list, b: list, n: int) -> int:
    grams = lambda t: Counter(zip(*(t[k:] for k in range(n))))
    return (grams(a) & grams(b)).total()


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        m = masks.get(y, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return len(a) - v.bit_count()


def lcs_places(a: list, b: list) -> set[int]:
    """Places in ``a`` of one longest common subsequence: from the ends, equal
    words are taken, else the side with the longer rest is kept (the first on ties)."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif rows[i][j - 1] > rows[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out


def union_hits(pred: list[list], ref: list[list]) -> int:
    """Words of the reference sentences in the union of their longest common
    subsequences with every predicted sentence, each word as often as both sides hold it."""
    left, held = Counter(w for s in pred for w in s), Counter(w for s in ref for w in s)
    hits = 0
    for r in ref:
        places = set().union(*(lcs_places(r, p) for p in pred)) if pred else set()
        for w in (r[k] for k in sorted(places)):
            if left[w] > 0 and held[w] > 0:
                hits += 1
                left[w] -= 1
                held[w] -= 1
    return hits


def pair_scores(pred: list[list], ref: list[list], which: tuple[str, ...] = NAMES) -> dict:
    """Precision and recall of the wanted scores for two texts as lists of sentences."""
    p, r = [w for s in pred for w in s], [w for s in ref for w in s]
    share = lambda hits, np_, nr: {"p": hits / np_ if np_ > 0 else 0.0, "r": hits / nr if nr > 0 else 0.0}
    score = {"rouge1": lambda: share(ngram_overlap(p, r, 1), len(p), len(r)), "rouge2": lambda: share(ngram_overlap(p, r, 2), len(p) - 1, len(r) - 1),
             "rougeL": lambda: share(lcs_length(p, r), len(p), len(r)), "rougeLsum": lambda: share(union_hits(pred, ref), len(p), len(r))}
    return {name: score[name]() for name in which}


def _stemmed(rows: DataFrame) -> DataFrame:
    """Token columns ``p`` and ``r`` with the stems of words of more than three letters.

    The vocabulary is stemmed once; each row takes up the stems of its own words."""
    keyed = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "rouge-tokens")
    words = keyed.select("_row", F.explode(F.array_distinct(F.flatten(F.concat("p", "r")))).alias("word")).filter(F.length("word") > 3)
    stems = materialise(with_stems(words.select("word").distinct(), "word"), "stems").filter(F.col("stem") != F.col("word"))
    maps = words.join(stems, "word").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "stem"))).alias("m"))
    both = keyed.join(maps, "_row", "left")
    turn = lambda c: F.transform(c, lambda s: F.transform(s, lambda w: F.coalesce(F.col("m")[w], w)))
    return both.withColumn("p", turn("p")).withColumn("r", turn("r")).drop("_row", "m")


def rouge_scores(pairs: DataFrame, *, id_col: str = "id", pred: str = "prediction", ref: str = "reference", stem: bool = False,
                 which: tuple[str, ...] = NAMES) -> DataFrame:
    """(id, rouge1, rouge2, rougeL, rougeLsum) as wanted, each a struct (p, r) of precision and recall."""
    rows = pairs.select(F.col(id_col), sentence_tokens(F.coalesce(F.col(pred), F.lit(""))).alias("p"), sentence_tokens(F.coalesce(F.col(ref), F.lit(""))).alias("r"))
    rows = _stemmed(rows) if stem else rows

    @F.pandas_udf(f"struct<{','.join(f'{n}:struct<p:double,r:double>' for n in which)}>")
    def score(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pair_scores([list(s) for s in a], [list(s) for s in b], which) for a, b in zip(p, r)], columns=list(which))

    return rows.select(id_col, score("p", "r").alias("s")).select(id_col, "s.*")


def _measure(scores: DataFrame, id_col: str, name: str) -> DataFrame:
    p, r = F.col(f"{name}.p"), F.col(f"{name}.r")
    return scores.select(id_col, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("fmeasure"))


def rouge_n(pairs: DataFrame, n: int, *, id_col: str = "id", **columns) -> DataFrame:
    """(id, precision, recall, fmeasure) of n-gram multiset overlap, n = 1 or 2."""
    if n not in (1, 2):
        raise ValueError("n must be 1 or 2")
    return _measure(rouge_scores(pairs, id_col=id_col, which=(f"rouge{n}",), **columns), id_col, f"rouge{n}")


def rouge_l(pairs: DataFrame, *, id_col: str = "id", **columns) -> DataFrame:
    """(id, precision, recall, fmeasure) of the longest common subsequence of the whole texts."""
    return _measure(rouge_scores(pairs, id_col=id_col, which=("rougeL",), **columns), id_col, "rougeL")


def rouge_lsum(pairs: DataFrame, *, id_col: str = "id", **columns) -> DataFrame:
    """(id, precision, recall, fmeasure) of the union of the sentences' longest common subsequences."""
    return _measure(rouge_scores(pairs, id_col=id_col, which=("rougeLsum",), **columns), id_col, "rougeLsum")


def rouge_summary(pairs: DataFrame, *, id_col: str = "id", **columns) -> DataFrame:
    """(metric, fmeasure): corpus means of rouge1, rouge2, rougeL and rougeLsum, one pass."""
    scores = rouge_scores(pairs, id_col=id_col, **columns)
    f = lambda n: F.when(F.col(f"{n}.p") + F.col(f"{n}.r") > 0, 2 * F.col(f"{n}.p") * F.col(f"{n}.r") / (F.col(f"{n}.p") + F.col(f"{n}.r"))).otherwise(0.0)
    means = scores.agg(*[F.avg(f(n)).alias(n) for n in NAMES], F.count("*").alias("n")).filter("n > 0")
    return means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("fmeasure")) for n in NAMES])).alias("m")).select("m.*")
