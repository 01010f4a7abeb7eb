"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation shall read ``(system? (user assistant)+)?`` by the initials of its
roles. Its rows, in order of turn, are kept (cost 0), re-roled to user or
assistant (3) or deleted (4; blank and duplicate rows must be), and empty user or
assistant rows may be inserted anywhere (3); a truncated row that stays costs 3
more. Wanted is the cheapest list of edits, of these the one whose initials
(``D I K R``, the *audit*) are least in ASCII order.

The pattern has four states (nothing yet, after system, user, assistant). For a
stretch of rows a forward vector holds each state's least cost and the rank of
its least audit, a backward vector the least cost from each state to the end.
They meet in the middle; the crossing state with the least sum, and of these the
least audit, splits the stretch into two that are solved alike, so only the
vectors are held (linear space). Insertions belong to the row that follows them,
so that no audit of a stretch is the beginning of another and ranks decide.

Long conversations are not one task. Rows are range-sorted by conversation, turn,
role and text hash, and cut into blocks of at most ``block_rows``. A block's four
forward vectors (one for each state it can begin in) are a 4 x 4 table; these
tables alone are gathered by conversation (one of them for ``block_rows`` rows),
and a backward and a forward walk over them gives every block its first and last
state. Then all blocks are solved independently. Only :func:`summary`, whose
digest runs over all texts of a conversation in order, streams a conversation
through one task, a row at a time.

Defined results: null roles and texts count as one space; null turns come first;
rows of one turn stand by role, then by the text's SHA-256; a null conversation
id is a conversation of its own; equal rows are one row with a count, whose
copies are duplicates and deleted; very long texts are only hashed, never held
more than once; a conversation without rows has an empty audit and costs
nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import type_of

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
FAR = 1 << 60
#: State after an inserted or re-roled row: user, but assistant after user.
NEXT = (2, 2, 3, 2)
#: Cost and audit of the insertions that end a conversation from each state.
TAIL_COST = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")
ROLE = {2: "user", 3: "assistant"}
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}

_SPACE = r"\x20\x09-\x0D"


# -- one row --------------------------------------------------------------------

def _transitions(kind: str) -> list[dict[int, tuple[int, str]]]:
    """For each state before a row of ``kind`` (role initial, fault): the least
    cost and audit of its insertions and edit to each state after it."""
    initial, fault = kind
    extra = TRUNCATED if fault == "t" else 0
    out: list[dict[int, tuple[int, str]]] = []
    for q in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, cost, audit = q, 0, ""
        for _ in range(3):  # two insertions reach every state there is to reach
            options = [(at, DELETE, "D")]
            if fault not in "bd":
                options.append((NEXT[at], REROLE + extra, "R"))
                if at in KEPT[initial]:
                    options.append((KEPT[initial][at], extra, "K"))
            for to, c, letter in options:
                best[to] = min(best.get(to, (FAR, "")), (cost + c, audit + letter))
            at, cost, audit = NEXT[at], cost + INSERT, audit + "I"
        out.append(best)
    return out


STEPS = {i + f: _transitions(i + f) for i in "suax" for f in "-bdt"}

Vector = tuple[list[int], list[int]]  # least cost and rank of the least audit of each state


def _start(q: int) -> Vector:
    return [0 if k == q else FAR for k in range(4)], [0] * 4


def forward(kinds: list[str], lo: int, hi: int, q: int) -> Vector:
    """Least cost and audit rank of each state after rows lo..hi from state q."""
    costs, ranks = _start(q)
    for k in range(lo, hi):
        best: list[tuple[int, int, str] | None] = [None] * 4
        for before, steps in enumerate(STEPS[kinds[k]]):
            if costs[before] >= FAR:
                continue
            for after, (cost, audit) in steps.items():
                new = (costs[before] + cost, ranks[before], audit)
                if best[after] is None or new < best[after]:
                    best[after] = new
        order = sorted(b[1:] for b in best if b is not None)
        costs = [FAR if b is None else b[0] for b in best]
        ranks = [0 if b is None else order.index(b[1:]) for b in best]
    return costs, ranks


def backward(kinds: list[str], lo: int, hi: int, costs: list[int]) -> list[int]:
    """Least cost from each state before rows lo..hi, given the costs after them."""
    for k in range(hi - 1, lo - 1, -1):
        costs = [min((costs[after] + cost for after, (cost, _) in steps.items()), default=FAR) for steps in STEPS[kinds[k]]]
    return costs


def cross(before: Vector, after: list[int]) -> int:
    """The state on the cheapest way, of these the one with the least audit so far."""
    return min((before[0][q] + after[q], before[1][q], q) for q in range(4) if before[0][q] < FAR)[2]


def hirschberg(kinds: list[str], lo: int, hi: int, q: int, end: int) -> list[str]:
    """Edits of each row lo..hi on the audit-least cheapest way from state q to state end."""
    if hi - lo <= 1:
        return [STEPS[kinds[lo]][q][end][1]] if hi > lo else []
    mid = (lo + hi) // 2
    at = cross(forward(kinds, lo, mid, q), backward(kinds, mid, hi, [0 if k == end else FAR for k in range(4)]))
    return hirschberg(kinds, lo, mid, q, at) + hirschberg(kinds, mid, hi, at, end)


def repair_list(kinds: list[str]) -> str:
    """The whole audit of one short conversation."""
    end = cross(forward(kinds, 0, len(kinds), 0), list(TAIL_COST))
    return "".join(hirschberg(kinds, 0, len(kinds), 0, end)) + TAIL[end]


# -- all conversations -------------------------------------------------------------

def rows_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text)``; null roles and texts as one space."""
    c = lambda name: F.col(f"`{name}`")
    return conversations.select(c(conv_col).alias("conv"), c(turn_col).cast("long").alias("turn"), F.coalesce(c(role_col).cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(c(text_col).cast("string"), F.lit(" ")).alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Faults by crc32(``conv:turn``) % 20: 0 drops the row, 1 empties its text, 2
    removes its full stops, 3 repeats it, 4 makes its role user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv"), F.lit(":"), text("turn")).cast("binary")) % 20
    marked = rows.withColumn("fault", fault).filter("fault <> 0").select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"))
    return marked.drop("copy")


def _kinds(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, sha, n, kind)``: different rows, their copies, role initial and first fault."""
    initial = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    whole = F.col("text").rlike(f"[.!?][{_SPACE}]*+\\z")
    slim = rows.select("conv", "turn", "role", F.sha2("text", 256).alias("sha"), blank.alias("blank"), whole.alias("whole"))
    one = slim.groupBy("conv", "turn", "role", "sha", "blank", "whole").agg(F.count("*").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))  # nulls first
    first = one.groupBy(F.col("conv").alias("of"), F.col("role").alias("as"), F.col("sha").alias("said")).agg(F.min(turn).alias("first"))
    met = one.join(first, one["conv"].eqNullSafe(first["of"]) & (one["role"] == first["as"]) & (one["sha"] == first["said"]))
    later = F.col("first")["known"].cast("int") < F.col("turn").isNotNull().cast("int")
    later = later | F.coalesce(F.col("first")["turn"] < F.col("turn"), F.lit(False))
    fault = F.when(F.col("blank"), "b").when(later, "d").when(~F.col("whole"), "t").otherwise("-")
    return met.select("conv", "turn", "role", "sha", "n", F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault).alias("kind"))


def _in_order(df: DataFrame, *more: str) -> DataFrame:
    return df.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "sha", *more)


def _blocks(kinds: DataFrame, block_rows: int) -> DataFrame:
    """``(conv, block, turns, roles, shas, ns, kinds, costs, ranks)``: stretches of one
    conversation, numbered in order, with the forward vectors from each state."""
    ranged = kinds.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "role", "sha")
    lists = [("turns", T.LongType(), pa.int64()), ("roles", T.StringType(), pa.string()), ("shas", T.StringType(), pa.string()), ("ns", T.LongType(), pa.int64()),
             ("kinds", T.StringType(), pa.string()), ("costs", T.LongType(), pa.int64()), ("ranks", T.LongType(), pa.int64())]
    schema = T.StructType([T.StructField("conv", type_of(kinds, "conv")), T.StructField("block", T.LongType()), *[T.StructField(n, T.ArrayType(t)) for n, t, _ in lists]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        done: list[tuple] = []

        def close() -> None:
            nonlocal number, held
            if held:
                turns, roles, shas, ns, kinds_ = map(list, list(zip(*held))[1:])
                vectors = [forward(kinds_, 0, len(kinds_), q) for q in range(4)]
                done.append((held[0][0], number, turns, roles, shas, ns, kinds_, [c for v in vectors for c in v[0]], [r for v in vectors for r in v[1]]))
                number, held = number + 1, []

        def result() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), *[pa.list_(t) for _, _, t in lists]]
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(types)], names=schema.names)
            done.clear()
            return out

        conv_type = None
        for b in batches:
            conv_type = b.schema.field("conv").type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (held[0][0] != row[0] or len(held) >= block_rows):
                    close()
                held.append(row)
            if len(done) >= 256:
                yield result()
        close()
        if done:
            yield result()

    return _in_order(ranged).select("conv", "turn", "role", "sha", "n", "kind").mapInArrow(run, schema)


def _states(blocks: DataFrame) -> DataFrame:
    """``(block, first, last, ends)``: the states between which each block is solved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(tables: list[tuple]) -> list[tuple]:
            ends = [list(TAIL_COST)]
            for _, costs, _ in reversed(tables):
                ends.append([min(costs[4 * q + k] + ends[-1][k] for k in range(4)) for q in range(4)])
            out, q = [], 0
            for k, (block, costs, ranks) in enumerate(tables):
                to = cross((costs[4 * q:4 * q + 4], ranks[4 * q:4 * q + 4]), ends[len(tables) - 1 - k])
                out.append((block, q, to, k + 1 == len(tables)))
                q = to
            return out

        held: list[tuple] = []
        own: tuple = ()
        for b in batches:
            out = []
            for conv, *table in zip(*(c.to_pylist() for c in b.columns)):
                if own != (conv,):
                    out += solve(held)
                    held, own = [], (conv,)
                held.append(tuple(table))
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "first", "last", "ends"), x)) for x in out], schema=arrow)
        yield pa.RecordBatch.from_pylist([dict(zip(("block", "first", "last", "ends"), x)) for x in solve(held)], schema=arrow)

    arrow = pa.schema([("block", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("ends", pa.bool_())])
    tables = blocks.select("conv", "block", "costs", "ranks").repartition("conv").sortWithinPartitions("conv", "block")
    return tables.mapInArrow(run, "block long, first int, last int, ends boolean")


def repair(rows: DataFrame, block_rows: int = 4096) -> DataFrame:
    """``(conv, turn, role, sha, n, kind, edits, tail)`` of every different row of
    ``rows`` (see :func:`rows_of`): initials of the insertions before it and of
    its own edit, and the insertions that end the conversation after it."""
    blocks = materialise(_blocks(_kinds(rows), block_rows), "blocks")
    states = _states(blocks).withColumnRenamed("block", "of")
    both = blocks.join(states, blocks["block"] == states["of"]).select("conv", "turns", "roles", "shas", "ns", "kinds", "first", "last", "ends")
    solved = T.StructType([T.StructField("conv", type_of(rows, "conv")), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("sha", T.StringType()),
                           T.StructField("n", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("edits", T.StringType()), T.StructField("tail", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            types = [b.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            for block in zip(*(c.to_pylist() for c in b.columns)):
                conv, turns, roles, shas, ns, kinds, first, last, ends = block
                edits = hirschberg(kinds, 0, len(kinds), first, last)
                tails = [""] * (len(kinds) - 1) + [TAIL[last] if ends else ""]
                columns = [[conv] * len(kinds), turns, roles, shas, ns, kinds, edits, tails]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=solved.names)

    return both.mapInArrow(run, solved)


def summary(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """One row a conversation that has rows: its faults, cost, audit and the
    SHA-256 of the repaired ``role:text`` lines."""
    decided = edits.select("conv", "turn", "role", "sha", F.lit(0).alias("part"), "n", "kind", "edits", "tail", F.lit(None).cast("string").alias("text"))
    none = lambda t: F.lit(None).cast(t)
    texts = rows.select("conv", "turn", "role", F.sha2("text", 256).alias("sha"), F.lit(1).alias("part"), none("long").alias("n"), none("string").alias("kind"),
                        none("string").alias("edits"), none("string").alias("tail"), "text")
    ordered = _in_order(decided.unionByName(texts).repartition("conv"), "part")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([T.StructField("conv", type_of(rows, "conv")), *[T.StructField(c, T.LongType()) for c in counts],
                           T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk: _Talk | None = None
        for b in batches:
            types = [b.schema.field("conv").type, *[pa.int64()] * len(counts), pa.string(), pa.string()]
            out = []
            for conv, *row in zip(*(c.to_pylist() for c in b.columns)):
                if talk is None or talk.conv != conv:
                    if talk is not None:
                        out.append(talk.result())
                    talk = _Talk(conv)
                talk.add(*row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=schema.names)
        if talk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(talk.result(), types)], names=schema.names)

    return ordered.mapInArrow(run, schema)


class _Talk:
    """A conversation as its rows go by."""

    def __init__(self, conv: object):
        self.conv, self.state, self.audit, self.tail = conv, 0, [], ""
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.low: int | None = None
        self.high: int | None = None
        self.turns = 0
        self.initial: str | None = None
        self.wanted: str | None = None  # the role of the kept row whose text comes next
        self.digest, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + role + ":").encode())
        self.digest.update(text.encode())
        self.lines += 1

    def insert(self, times: int) -> None:
        for _ in range(times):
            self.state = NEXT[self.state]
            self.line(ROLE[self.state], "")
        self.cost += INSERT * times

    def add(self, turn: int | None, role: str, sha: str, part: int, n: int | None, kind: str | None, edits: str | None, tail: str | None, text: str | None) -> None:
        if part:  # the text of the row just decided; its copies' texts follow and are not wanted
            if self.wanted is not None:
                self.line(self.wanted, text)
                self.wanted = None
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.illegal += n - 1
        self.initial = role[:1]
        fault = kind[1]
        if fault == "b":
            self.blank += n
        else:
            self.truncated += fault == "t"
            self.duplicate += n - (fault != "d")
        self.insert(len(edits) - 1)
        letter = edits[-1]
        if letter == "D":
            self.cost += DELETE
        else:
            self.cost += (REROLE if letter == "R" else 0) + (TRUNCATED if fault == "t" else 0)
            self.state = KEPT[kind[0]][self.state] if letter == "K" else NEXT[self.state]
            self.wanted = role if letter == "K" else ROLE[self.state]
        self.cost += DELETE * (n - 1)
        self.audit.append(edits + "D" * (n - 1))
        self.tail = tail

    def result(self) -> tuple:
        self.insert(len(self.tail))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit) + self.tail, self.digest.hexdigest())
