import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.llm import queries
from corpuslens.llm.conversation_repair import STEPS, backward, forward, hirschberg, repair, repair_list, rows_of, summary, damage

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile("[^\x20\x09-\x0d]")


def brute(kinds):
    """Cheapest edits of (initial, fault) rows, ASCII-least, by trying all ways state by state with whole audits."""
    pattern = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    ways = {"": (0, "")}  # last initial -> (cost, audit)

    def inserted(ways):
        out = dict(ways)
        for _ in range(4):
            for last, (cost, audit) in list(out.items()):
                for to in pattern[last]:
                    if to != "s":
                        out[to] = min(out.get(to, (10 ** 9, "")), (cost + 3, audit + "I"))
        return out

    for initial, fault in kinds:
        new = {}
        more = 3 if fault == "t" else 0
        # insertions belong to the row after them, so all lengths of insertions are tried
        for last, (cost, audit) in ways.items():
            for n in range(3):
                at, ok = last, True
                for _ in range(n):
                    at = "a" if at == "u" else "u"
                base, said = cost + 3 * n, audit + "I" * n
                options = [(at, base + 4, said + "D")]
                if fault not in "bd":
                    options.append(("a" if at == "u" else "u", base + 3 + more, said + "R"))
                    if initial in pattern[at]:
                        options.append((initial, base + more, said + "K"))
                for to, c, a in options:
                    new[to] = min(new.get(to, (10 ** 9, "")), (c, a))
        ways = new
    return min(w for last, w in inserted(ways).items() if last in ("", "a"))


ROWS = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("--bdt")), max_size=14)


@settings(max_examples=400, deadline=None)
@given(ROWS)
def test_hirschberg_finds_the_least_cheapest_audit(kinds):
    audit = repair_list([i + f for i, f in kinds])
    cost, want = brute(kinds)
    assert audit == want
    assert min(c + t for c, t in zip(forward([i + f for i, f in kinds], 0, len(kinds), 0)[0], (0, 6, 3, 0))) == cost


def test_brute_force_itself_against_all_edit_lists():
    pattern = re.compile("(s?(ua)+)?")
    for kinds in itertools.product([("s", "-"), ("u", "-"), ("a", "-"), ("a", "b"), ("u", "t")], repeat=2):
        best = None
        for edits in itertools.product("KRD", repeat=2):
            for inserts in itertools.product(["", "u", "a", "ua", "au"], repeat=3):
                for roles in itertools.product("ua", repeat=2):
                    said, audit, cost = "", "", 0
                    for (initial, fault), e, ins, r in zip(kinds, edits, inserts, roles):
                        said, audit, cost = said + ins, audit + "I" * len(ins) + e, cost + 3 * len(ins)
                        if e != "D" and fault == "b":
                            cost += 10 ** 6
                        cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if e != "D" and fault == "t" else 0)
                        said += {"K": initial, "R": r, "D": ""}[e]
                    said, audit, cost = said + inserts[2], audit + "I" * len(inserts[2]), cost + 3 * len(inserts[2])
                    if pattern.fullmatch(said):
                        best = min(best or (cost, audit), (cost, audit))
        assert brute(kinds) == best, kinds


def test_backward_and_forward_agree_at_every_crossing():
    kinds = ["u-", "ad", "x-", "st", "ub", "a-", "u-"]
    total = min(c + t for c, t in zip(forward(kinds, 0, 7, 0)[0], (0, 6, 3, 0)))
    for mid in range(8):
        f, b = forward(kinds, 0, mid, 0)[0], backward(kinds, mid, 7, [0, 6, 3, 0])
        assert min(x + y for x, y in zip(f, b)) == total
    assert len(hirschberg(kinds, 2, 5, 2, 3)) == 3
    assert set(STEPS) == {i + f for i in "suax" for f in "-bdt"}


def expected(rows):
    """Contract columns of one conversation's damaged rows, in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        last = [c for c in text if BLANK.match(c)]
        fault = "b" if not last else "d" if (role, text) in seen else "t" if last[-1] not in ".!?" else "-"
        seen.add((role, text))
        kinds.append((role[:1] if role[:1] in "sua" and role else "x", fault))
    cost, audit = brute(kinds)
    out, state, k = [], "", 0
    for e in audit:
        if e == "I":
            state = "a" if state == "u" else "u"
            out.append({"u": "user", "a": "assistant"}[state] + ":")
            continue
        _, role, text = rows[k]
        k += 1
        if e == "K":
            state = role[:1]
            out.append(f"{role}:{text}")
        elif e == "R":
            state = "a" if state == "u" else "u"
            out.append({"u": "user", "a": "assistant"}[state] + ":" + text)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    faults = [f for _, f in kinds]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


TALKS = [
    [(0, "system", "Be brief."), (1, "user", "Hello there"), (2, "assistant", "Hi!"), (4, "user", "Bye."), (5, "assistant", "Bye.")],
    [(0, "assistant", "First."), (0, "assistant", "First."), (1, "assistant", " "), (1, "user", ""), (9, "user", "Ünï. \n")],
    [(None, "user", "a."), (None, "user", "b."), (3, "tool", "c."), (3, "tool", "c."), (7, "", "d."), (8, " ", "e!\t")],
    [(2, "user", "q?"), (1, "user", "q?"), (3, "user", "q?"), (4, "assistant", "x" * 5000)],
    [(5, "user", "only.")], [(5, "system", "only.")], [(1, "a", "Same."), (2, "u", "Same."), (3, "summary", "Same.")],
]


@pytest.mark.parametrize("block_rows", [4096, 2, 1])
def test_rows_and_blocks_equal_brute_force(spark, block_rows):
    rows = [(c if c else None, *r) for c, talk in enumerate(TALKS) for r in talk]
    df = rows_of(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {r["conv"]: tuple(r)[1:] for r in summary(repair(df, block_rows), df).collect()}
    assert got == {c if c else None: expected(talk) for c, talk in enumerate(TALKS)}


def test_long_conversation_over_many_blocks(spark):
    talk = [(k // 2 if k % 7 else k // 2 - 3, ("user", "assistant", "system", "tool")[zlib.crc32(b"%d" % k) % 11 % 4], f"text {k % 41}" + "." * (k % 3)) for k in range(900)]
    df = rows_of(spark.createDataFrame([(1, *r) for r in talk], SCHEMA).repartition(6))
    got = summary(repair(df, 16), df).collect()
    assert [tuple(r)[1:] for r in got] == [expected(talk)]


def test_nulls_empty_table_and_clashing_columns(spark):
    rows = [(1, 1, None, None), (None, None, "user", "Hi."), (None, None, None, None), (2, 1, "user", "Hello.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit(7)).withColumn("kind", F.lit("z")).withColumn("sha", F.lit(0))
    df = rows_of(df)
    got = {r["conv"]: tuple(r)[1:] for r in summary(repair(df), df).collect()}
    assert got == {1: expected([(1, " ", " ")]), None: expected([(None, "user", "Hi."), (None, " ", " ")]), 2: expected([(1, "user", "Hello.")])}
    none = rows_of(spark.createDataFrame([], SCHEMA))
    assert summary(repair(none), none).collect() == []


def test_query_equals_brute_force(spark, sf):
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], [])
        fault = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", r["text"]) if fault == 2 else r["text"]
        talks[r["conv_id"]] += [(r["turn"], "user" if fault == 4 else r["role"], text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13(spark, sf).collect()}
    assert got == {c: expected(talk) for c, talk in talks.items()}


def test_damage_of_null_keys(spark):
    df = rows_of(spark.createDataFrame([(None, None, None, None)], SCHEMA))
    fault = zlib.crc32(b" : ") % 20
    assert damage(df).count() == (0 if fault == 0 else 2 if fault == 3 else 1)
