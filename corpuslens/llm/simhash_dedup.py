"""SimHash near-duplicate groups by a distributed binary-trie self-join.

1. *Fingerprints.* One pass over whole texts (Arrow batches); only
   ``(id, fingerprint)`` leaves the task. Exact copies collapse to one
   fingerprint through a partial aggregate, so a group of copies of any size
   costs one trie leaf.
2. *Trie self-join.* The join walks pairs of trie nodes, adds up the bits in
   which their prefixes differ and drops a pair once the error budget is
   exceeded. Two fingerprints within ``d`` bits agree in at least one of
   ``d + 1`` bit blocks, so the walk starts below the root at the nodes
   ``(A, A)`` of ``d + 1`` tries, each with another block rotated to the front:
   every link is met in at least one of them, and no task sees all
   fingerprints. A node pair with more than ``max_members`` fingerprints is
   descended by Spark (each member goes to the child pairs it can still match
   within the budget) until it fits; the rest of the walk runs inside tasks.
3. *Links.* A task emits a spanning forest of the links it finds (at most
   members - 1 edges a node pair), which keeps connectivity whole without
   listing all pairs of a dense group.
4. *Components.* Alternating large-star / small-star rounds over the forest
   edges, each round written to the shared scratch folder; hot centres are
   min-aggregated before any join.

Defined results: a null, empty or white-space text has fingerprint zero and is
linked like any other; repeated rows share fingerprint and component; a null id
gets its group's component; an empty table gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import strings, type_of

BITS = 64
SEED = 42


# -- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only; \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle_words:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle_words)))]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(g, SEED) for g in grams]), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(raw), 8192):  # bounded memory for very long texts
        counts += np.unpackbits(raw[at:at + 8192], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``(id, fp)`` of every row; fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in strings(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, type_of(docs, id_col)), T.StructField("fp", T.LongType())])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


# -- trie self-join ---------------------------------------------------------

def _rotations(max_distance: int) -> list[tuple[int, int]]:
    """(left rotation, width) of each bit block that is brought to the front."""
    cuts = [BITS * k // (max_distance + 1) for k in range(max_distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _rotl(c: Column, by: int) -> Column:
    return c if by == 0 else F.shiftleft(c, by).bitwiseOR(F.shiftrightunsigned(c, BITS - by))


def _roots(fps: DataFrame, max_distance: int) -> DataFrame:
    """Members of the node pairs (A, A) of every rotated trie."""
    nodes = [F.struct(F.lit(k).alias("trie"), F.lit(width).alias("depth"), F.shiftrightunsigned(_rotl(F.col("fp"), by), BITS - width).alias("a"), _rotl(F.col("fp"), by).alias("x"))
             for k, (by, width) in enumerate(_rotations(max_distance))]
    return (fps.select(F.explode(F.array(*nodes)).alias("n"))
            .select("n.trie", "n.depth", "n.a", F.col("n.a").alias("b"), F.lit(0).alias("side"), "n.x"))


def _descend(members: DataFrame, max_distance: int, step: int) -> DataFrame:
    """Send the members of node pairs to the child pairs within the error budget."""
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << step) if m.bit_count() <= max_distance])
    own, other = F.when(F.col("side") == 0, F.col("a")).otherwise(F.col("b")), F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a"))
    spent = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    chunk = F.expr(f"shiftrightunsigned(x, {BITS} - depth - {step})").bitwiseAND(F.lit((1 << step) - 1))
    grown = members.select("trie", "depth", "a", "b", "side", "x",
                           F.explode(F.filter(masks, lambda m: F.bit_count(m) + spent <= max_distance)).alias("mask"))
    mine = F.shiftleft(own, step).bitwiseOR(chunk)
    theirs = F.shiftleft(other, step).bitwiseOR(chunk.bitwiseXOR(F.col("mask")))
    one_node = F.col("a") == F.col("b")
    side = F.when(one_node, F.when(mine <= theirs, 0).otherwise(1)).otherwise(F.col("side"))
    first = side == 0
    return grown.select("trie", (F.col("depth") + step).alias("depth"), F.when(first, mine).otherwise(theirs).alias("a"),
                        F.when(first, theirs).otherwise(mine).alias("b"), side.alias("side"), "x")


def node_pairs(fps: DataFrame, max_distance: int, max_members: int = 4096, step: int = 8) -> DataFrame:
    """Members of node pairs small enough for one task each: every link of
    distinct fingerprints lies inside at least one pair."""
    key = ["trie", "depth", "a", "b"]
    open_, done = _roots(fps, max_distance), None
    while True:
        hot = open_.groupBy(*key).count().filter((F.col("count") > max_members) & (F.col("depth") + step <= BITS)).drop("count")
        hot = materialise(hot, "hot-nodes")
        if hot.isEmpty():
            return open_ if done is None else done.unionByName(open_)
        cold = open_.join(hot, key, "left_anti").select(*open_.columns)
        done = cold if done is None else done.unionByName(cold)
        open_ = materialise(_descend(open_.join(hot, key, "left_semi"), max_distance, step), "node-members")


def _split(v: np.ndarray, lo: int, hi: int, bit: int) -> int:
    """Where the node's children part: the first value in v[lo:hi] with the bit set."""
    last = v[hi - 1]
    if not last & np.uint64(1 << bit):
        return hi
    return lo + int(np.searchsorted(v[lo:hi], last & ~np.uint64((1 << bit) - 1)))


def _walk(x: np.ndarray, y: np.ndarray | None, budget: int, tile: int = 64) -> Iterator[tuple[int, int, int, int]]:
    """Leaf ranges ``(a0, a1, b0, b1)`` of the pairwise trie walk over sorted
    fingerprints: x against itself (y None) or against y."""
    other = x if y is None else y
    stack = [(0, len(x), 0, len(other), BITS - 1, budget)]
    while stack:
        a0, a1, b0, b1, bit, left = stack.pop()
        if a0 >= a1 or b0 >= b1 or left < 0:
            continue
        if bit < 0 or (a1 - a0 <= tile and b1 - b0 <= tile):
            yield a0, a1, b0, b1
            continue
        am, bm = _split(x, a0, a1, bit), _split(other, b0, b1, bit)
        stack.append((a0, am, b0, bm, bit - 1, left))
        stack.append((am, a1, bm, b1, bit - 1, left))
        stack.append((a0, am, bm, b1, bit - 1, left - 1))
        if not (y is None and (a0, a1) == (b0, b1)):  # a node with itself: its two children meet once
            stack.append((am, a1, b0, bm, bit - 1, left - 1))


def forest(x: np.ndarray, y: np.ndarray | None, max_distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among sorted x (or between x and y).

    Returns index pairs into ``concatenate([x, y])``.
    """
    values = x if y is None else np.concatenate([x, y])
    shift = 0 if y is None else len(x)
    label = np.arange(len(values))
    out: list[tuple[int, int]] = []
    other = values[shift:]
    for a0, a1, b0, b1 in _walk(x, y, max_distance):
        near = np.bitwise_count(x[a0:a1, None] ^ other[None, b0:b1]) <= max_distance
        while True:
            la, lb = label[a0:a1], label[shift + b0:shift + b1]
            new = near & (la[:, None] != lb[None, :])
            at = int(new.argmax())
            i, j = divmod(at, b1 - b0)
            if not new[i, j]:
                break
            out.append((a0 + i, shift + b0 + j))
            label[label == lb[j]] = la[i]
    return out


def links(members: DataFrame, max_distance: int) -> DataFrame:
    """``(u, v)``: spanning-forest links of each node pair, as fingerprints."""
    turns = [by for by, _ in _rotations(max_distance)]

    def solve(trie: int, side: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        second = side == 1
        a, b = np.sort(x[~second]), np.sort(x[second])
        if second.any():
            pairs = forest(a, b, max_distance) if len(a) else []
        else:
            pairs = forest(a, None, max_distance)
        both = np.concatenate([a, b])
        by = np.uint64(turns[trie])
        back = both if not by else (both >> by) | (both << (np.uint64(BITS) - by))
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return back[at[:, 0]].view(np.int64), back[at[:, 1]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 6
        def flush(cols: list[np.ndarray], last: bool) -> tuple[list[np.ndarray], pa.RecordBatch]:
            n = len(cols[0])
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1 if n else np.empty(0, int)
            starts = np.concatenate([[0], change]) if n else change
            ends = np.concatenate([change, [n]]) if n else change
            if not last and n:
                keep = [c[starts[-1]:] for c in cols]
                starts, ends = starts[:-1], ends[:-1]
            else:
                keep = [c[:0] for c in cols]
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                u, v = solve(int(cols[0][s]), cols[4][s:e], cols[5][s:e].view(np.uint64))
                us.append(u)
                vs.append(v)
            return keep, pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for b in batches:
            got = [np.ascontiguousarray(c.to_numpy(zero_copy_only=False)).astype(np.int64) for c in b.columns]
            held, out = flush([np.concatenate(p) for p in zip(held, got)], False)
            yield out
        yield flush(held, True)[1]

    key = ["trie", "depth", "a", "b"]
    return (members.repartition(*key).sortWithinPartitions(*key)
            .select(*key, "side", "x").mapInArrow(run, "u long, v long"))


# -- components -------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` of every node that has an edge; root is the smallest
    node of its component. Alternating large-star and small-star rounds; raises
    if ``max_rounds`` do not suffice."""
    edges = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def fingerprint_roots(firsts: DataFrame, max_distance: int = 2, max_members: int = 4096) -> DataFrame:
    """``(fp, first, root)`` of rows ``(fp, first)`` with distinct fingerprints: root is
    the smallest fingerprint of the component."""
    firsts = materialise(firsts, "distinct-fingerprints")
    roots = components(links(node_pairs(firsts.select("fp"), max_distance, max_members), max_distance))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return materialise(rooted, "rooted")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3,
                   max_distance: int = 2, max_members: int = 4096) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row: 16 hex digits, and the
    smallest id reachable over links of at most ``max_distance`` bits."""
    fps = materialise(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    rooted = fingerprint_roots(fps.groupBy("fp").agg(F.min(F.col(f"`{id_col}`")).alias("first")), max_distance, max_members)
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(f"`{id_col}`", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
