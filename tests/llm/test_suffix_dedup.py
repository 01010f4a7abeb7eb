import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.llm import queries
from corpuslens.llm.suffix_dedup import remove_repeats, suffix_array

SCHEMA = "doc_id long, text string"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array_is_sorted(s):
    s = [*s, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_array_of_periodic_and_lyndon_strings():
    for text in ("a" * 500, "ab" * 200, "abaab" * 60, "mississippi" * 9, "zyx" * 50, "abcdefgh"):
        s = [*text.encode(), 0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, size):
    """(id, kept bytes, spans) of each row, rows in order of origin."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (text or "").encode()
        mark = bytearray(len(b) + 1)
        for s in range(len(b) - size + 1):
            w = b[s:s + size]
            if w in seen:
                mark[s:s + size] = b"\1" * size
            seen.add(w)
        spans = [(s, next(e for e in range(s, len(b) + 1) if not mark[e])) for s in range(len(b)) if mark[s] and (s == 0 or not mark[s - 1])]
        out.append((i, len(b), spans, bytes(c for c, m in zip(b, mark) if not m)))
    return out


def got(df, *args, **kw):
    return [(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in remove_repeats(df, *args, **kw).collect()]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2], r[3])


WORDS = "der rasche Fuchs springt über faule Hunde am Ufer 日本 語の文 of an old and slow river bed".split()


def text_of(k, n):
    h = hashlib.md5(str(k).encode()).digest()
    return " ".join(WORDS[h[i % 16] * (i + 7) % len(WORDS)] for i in range(n))


@pytest.mark.parametrize("size,core,most", [(20, None, 16_384), (20, 5, 2), (12, 3, 1)])
def test_equals_brute_force(spark, size, core, most):
    rows = [(k, text_of(k % 17, 12 + k % 9) + (" " + text_of(k // 3, 9) if k % 2 else "") + "." * (k % 5)) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "short"), (103, "x" * 90), (104, "xy" * 40), (105, rows[3][1] * 3)]
    want = brute(rows, size)
    assert sorted(got(spark.createDataFrame(rows, SCHEMA).repartition(5), min_bytes=size, core=core, max_pieces=most), key=key) == sorted(want, key=key)


def test_equal_texts_null_and_repeated_ids(spark):
    a, b = text_of(1, 12), text_of(2, 12)
    rows = [(5, a), (5, a), (None, a), (None, a), (7, b), (7, b + " and more of it"), (None, "tiny"), (None, "tiny"), (2, a + " tail")]
    out = got(spark.createDataFrame(rows, SCHEMA), min_bytes=20)
    whole = [(0, len(a.encode()))]
    assert sorted(x for x in out if x[0] == 5) == [(5, len(a.encode()), whole, b"")] * 2
    assert [x for x in out if x[0] is None and x[1] > 4] == [(None, len(a.encode()), whole, b"")] * 2
    assert [x for x in out if x[0] is None and x[1] == 4] == [(None, 4, [], b"tiny")] * 2
    assert [x[2] for x in out if x[0] == 2] == [[]]
    seven = sorted(x[2] for x in out if x[0] == 7)
    assert sum(len(x) for x in seven) == 1  # the text's hash says which of the two comes first


def test_repeated_rows_keep_one(spark):
    rows = [(1, text_of(4, 12))] * 3 + [(2, "ab")] * 2
    out = got(spark.createDataFrame(rows, SCHEMA), min_bytes=20)
    assert sorted(len(x[3]) for x in out if x[0] == 1) == [0, 0, len(rows[0][1].encode())]
    assert [x[3] for x in out if x[0] == 2] == [b"ab"] * 2


def test_long_text_is_cut_into_stretches(spark, monkeypatch):
    from corpuslens.llm import suffix_dedup
    rows = [(1, "".join(text_of(k, 20) for k in range(12))), (2, text_of(5, 20) + text_of(6, 20)), (3, "".join(text_of(k, 20) for k in range(30, 36)))]
    texts = [t.encode() for _, t in rows]
    whole = [sorted(zip(*(x.tolist() for x in (key, digest, start))))
             for t in texts for _, _, raw, offsets in suffix_dedup._stretches([t], 20) for key, digest, _, start, _, _ in [suffix_dedup.pieces_of(raw, offsets, 20, 8)]]
    monkeypatch.setattr(suffix_dedup, "STRETCH", 64)
    for t, want in zip(texts, whole):
        places = set()
        for _, shifts, raw, offsets in suffix_dedup._stretches([t], 20):
            _, _, doc, start, windows, _ = suffix_dedup.pieces_of(raw, offsets, 20, 8)
            for d, s, n in zip(doc, start, windows):
                mine = range(shifts[d] + s, shifts[d] + s + n)
                assert not places & set(mine)
                places |= set(mine)
        assert places == set(range(len(t) - 19))  # every window once


def test_other_types_clashing_columns_and_empty_table(spark):
    text = text_of(9, 14)
    rows = spark.createDataFrame([("b", text, 1), ("a", text + "!", 2)], "doc_id string, text string, anchor int") \
        .withColumn("id", F.lit(1)).withColumn("tie", F.lit(2)).withColumn("n", F.lit(0))
    out = {x[0]: x[2] for x in got(rows, min_bytes=20)}
    assert out == {"a": [], "b": [(0, len(text.encode()))]}
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    seen, want = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s:s + 100]
            if w in seen:
                mark[s:s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, m in zip(b, mark) if not m)
        want[i] = (len(b), sum(mark), sum(1 for k in range(len(b)) if mark[k] and not (k and mark[k - 1])), hashlib.sha256(kept).hexdigest())
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op11(spark, sf).collect()} == want
