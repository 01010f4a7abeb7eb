import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import queries as Q
from corpuslens.llm import token_counts as C

RANKS = open(C.VOCABULARY, "rb").read()
TEXTS = ["", "one line", "two\nlines here\n", "\n\n\n", "Ünder 漢字 \U0001f600\U0001f601\n漢\nend  \n  x", "a" * 3000, " \t\n mixed\r\nrows\n", "word " * 20_000 + "\nlast"]


def brute(text, sections, rule):
    """One loop over tokens, decoded one by one, and all sections."""
    coder, _ = C.encoding(RANKS, C.PATTERN)
    ids = coder.encode_ordinary(text)
    starts_of = {}
    raw, at = text.encode(), 0
    chars = []  # character of each byte
    for i, c in enumerate(text):
        chars += [i] * len(c.encode())
    out, crossing = [0.0] * (len(sections) + 1), [0] * (len(sections) + 1)
    for t in ids:
        b = coder.decode_single_token_bytes(t)
        assert raw[at:at + len(b)] == b
        s, e, at = chars[at], chars[at + len(b) - 1] + 1, at + len(b)
        over = [max(0, min(e, z) - max(s, a)) for a, z in sections]
        free = (e - s) - sum(over)
        for k, (a, z) in enumerate(sections):
            crossing[k] += over[k] > 0 and e > z
        if rule == "share":
            for k, x in enumerate(over):
                out[k] += x / (e - s)
            out[-1] += free / (e - s)
        elif rule == "first":
            mine = [k for k, (a, z) in enumerate(sections) if a <= s < z]
            out[mine[0] if mine else -1] += 1
        else:
            best = max(range(len(sections)), key=lambda k: (over[k], -k), default=None)
            out[best if best is not None and over[best] and over[best] >= free else -1] += 1
    return out, crossing


@pytest.mark.parametrize("rule", C.RULES)
def test_attribution_equals_brute_force(rule):
    rng = random.Random(2)
    for text in TEXTS:
        a, z = C.lines(text)
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 40)))
        for sections in (list(zip(a.tolist(), z.tolist())), list(zip(cuts[::2], cuts[1::2])), []):
            s, e = C.token_spans(text, RANKS)
            got = C.attribute(s, e, np.array([x for x, _ in sections], np.int64), np.array([y for _, y in sections], np.int64), rule)
            want = brute(text, sections, rule)
            assert np.allclose(got[0], want[0]) and got[1].tolist() == want[1], (text[:20], rule)
            assert abs(got[0].sum() - len(s)) < 1e-6


def test_hard_rows(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (1, TEXTS[1]), (None, "x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("section", F.lit("x")).withColumn("start", F.lit(1.5))
    out = C.section_tokens(df).collect()
    per = {}
    for r in out:
        per.setdefault(r.doc_id, []).append(r)
    assert len(per[50]) == 1 and per[50][0].n_tokens == 0 and per[50][0].doc_tokens == 0
    for i, t in enumerate(TEXTS):
        if i != 1:
            assert sum(r.n_tokens for r in per[i]) == per[i][0].doc_tokens and len(per[i]) == len(C.lines(t)[0])
    assert len(per[1]) == 2 and len(per[None]) == 1
    assert C.section_tokens(df.limit(0)).count() == 0


def test_fields(spark):
    rows = [(1, "user", "héllo there"), (2, None, "a"), (3, "x", None)]
    df = C.join_fields(spark.createDataFrame(rows, "doc_id long, role string, body string"), ["role", "body"])
    out = C.section_tokens(df, sections_col="sections", rule="first").collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert {(r.doc_id, texts[r.doc_id][r.start:r.end]) for r in out if r.section >= 0} == {(1, "user"), (1, "héllo there"), (2, ""), (2, "a"), (3, "x"), (3, "")}
    for i in texts:
        assert sum(r.n_tokens for r in out if r.doc_id == i) == max(r.doc_tokens for r in out if r.doc_id == i)


def test_query_adds_up(spark, sf):
    out = Q.QUERIES["op2_token_counts"](spark, sf)
    bad = out.groupBy("doc_id").agg(F.sum("n_tokens").alias("a"), F.max("doc_tokens").alias("b")).filter("a <> b")
    assert bad.count() == 0 and out.select("doc_id").distinct().count() == 200
