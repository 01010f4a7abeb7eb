"""Removal of repeated byte strings by suffix arrays of linear grouping construction.

Every byte that is covered by a ``min_bytes``-byte string which also starts
earlier (smaller id, or same row and earlier start) is removed; strings are
judged on the input. A corpus has no suffix array that fits one machine, so
suffixes are first dealt to groups that must share all their equal strings:

1. *Anchors.* Each ``min_bytes`` window is represented by its least ``core``-byte
   substring (by a rolling hash, leftmost on ties). Equal windows have the same
   anchor at the same offset; consecutive windows with one anchor are one
   *piece* of at most ``2 * min_bytes - core`` bytes. Only ``(anchor, digest of
   the piece, id, place)`` is shuffled by anchor; anchors met once leave there.
   Of pieces that are byte for byte equal the first stays, and the windows of
   all others repeat it.
2. *Suffix arrays.* The different pieces of an anchor fetch their bytes, one
   join with the texts. Those that share an anchor grown by half of the rest on
   either side are concatenated (the shared core as one symbol) and their
   suffixes sorted by :func:`suffix_array`. Neighbours that agree over a whole
   window are one string; all but its first place are repeats.
3. An anchor with more than ``max_pieces`` different pieces is divided by Spark
   into anchors grown by half of the rest on either side, until it fits; so no
   task holds more than a bounded number of pieces.
4. The repeated runs of a row are merged and cut out, a second join with the texts.

Rows with equal texts need no suffixes: all but the first by (id, nulls last)
are removed whole, if they reach ``min_bytes``.

Defined results: a null text counts as empty; texts shorter than ``min_bytes``
stay whole; null ids come last and are told apart by the text's hash, as are
repeated ids; of repeated rows one is the first and the others repeat it; a very
long text is cut into overlapping stretches of 2 MiB for the anchors, its runs
are merged as one list; ``kept`` is binary, since a cut may fall inside a
character; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import small_batches, type_of

STRETCH = 1 << 21


# -- suffix array: linear construction by grouping --------------------------

def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of ``s``, whose last symbol is smaller than all others.

    Groups of suffixes that share a Lyndon prefix are taken in descending order.
    A member's previous-smaller pointer leads to the last place before it in a
    lower group; the places that so many members point to leave their group for
    a new one just above it, most pointed-to first. When all groups are done
    they are in order, and one walk over the array, which follows the pointers
    from each suffix's left neighbour, fills every group in order.
    """
    n = len(s)
    symbols = sorted(set(s))
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in s]
    lists: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        lists[g].append(i)
    top = len(symbols) - 1
    above = [*range(1, top + 1), -1]
    below = [-1, *range(top)]
    done = bytearray(n + 1)  # the last entry stands for place -1
    prev = [-1] * n

    g = top
    while g >= 0:
        own = [i for i in lists[g] if group[i] == g]
        for i in own:
            done[i] = 1
        own.sort()
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while done[p]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        levels = {c: [] for c in sorted(set(pointed.values()), reverse=True)}
        for p, c in pointed.items():
            levels[c].append(p)
        for places in levels.values():
            fresh: dict[int, int] = {}
            for p in places:
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(lists)
                    lists.append([])
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                group[p] = new
                lists[new].append(p)
        g = below[g]

    sizes = Counter(group)
    start, at, g = [0] * len(lists), 0, 0
    while g >= 0:  # group 0, the last symbol's, is the lowest
        start[g] = at
        at += sizes[g]
        g = above[g]
    out = [-1] * n
    out[0] = n - 1
    placed = bytearray(n + 1)
    placed[n] = placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while not placed[j]:
            placed[j] = 1
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            j = prev[j]
    return out


# -- anchors ------------------------------------------------------------------

def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BASE = 0x9E3779B97F4A7C15
_LETTERS, _LETTERS2 = _odd(11, 256), _odd(12, 256)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, made once a worker."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 2 ** 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def pieces_of(raw: np.ndarray, offsets: np.ndarray, size: int, core: int) -> tuple[np.ndarray, ...]:
    """Pieces of the texts ``raw[offsets[i]:offsets[i + 1]]``: anchor hash, digest
    of the piece, text number, start in the text, windows, offset of the anchor."""
    n = len(raw)
    if n < size:
        empty = np.empty(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * up[:n], out=total[1:])
    h = _mix((total[core:] - total[:-core]) * down[:n - core + 1])
    mask = np.uint64((1 << 23) - 1)
    least, wide, span = (h & ~mask) | np.arange(len(h), dtype=np.uint64), size - core + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[:span - wide], least[wide - span:])
    anchor = (least & mask).astype(np.int64)  # of the window that starts here
    del least
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(anchor)]
    whole = np.arange(len(anchor)) + size <= offsets[doc + 1]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    edges = np.flatnonzero(fresh | ~whole)
    ends = np.append(edges[1:], len(anchor))
    keep = whole[edges]
    start, windows = edges[keep], (ends - edges)[keep]
    np.cumsum(_LETTERS2[raw] * up[:n], out=total[1:])
    stop = start + windows + size - 1
    digest = _mix((total[stop] - total[start]) * down[start] + windows.astype(np.uint64))
    return h[anchor[start]], digest, doc[start], start - offsets[doc[start]], windows, anchor[start] - start


def _stretches(texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """Texts packed into buffers of about STRETCH bytes; a longer one is cut into
    stretches that overlap by a window less one byte: numbers, shifts, bytes, offsets."""
    rows: list[int] = []
    shifts: list[int] = []
    held: list[bytes] = []
    total = 0

    def flush() -> tuple[list[int], list[int], np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(held), np.uint8)
        return rows, shifts, raw, np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)

    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - size + 1, 0), STRETCH):
            part = text[at:at + STRETCH + size - 1]
            if held and total + len(part) > STRETCH:
                yield flush()
                rows, shifts, held, total = [], [], [], 0
            rows.append(k)
            shifts.append(at)
            held.append(part)
            total += len(part)
    if held:
        yield flush()


def _pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << 16) | (windows << 8) | offset


def _anchors(rows: DataFrame, size: int, core: int, id_type: T.DataType) -> DataFrame:
    """``(anchor, digest, id, tie, place, known)`` of every piece; place packs start,
    windows and the anchor's offset. A text that the task has already met under
    a smaller id is left out: the table of equal texts settles it. A piece that
    an equal one precedes in the same stretch of texts is known to be a repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[bytes, tuple] = {}
        for b in small_batches(batches, 2, 2 << 20):
            if len(met) >= 200_000:
                met.clear()
            ids, ties = b.column(0).to_pylist(), b.column(1).to_pylist()
            orders = [(i is None, i if i is not None else 0, t) for i, t in zip(ids, ties)]
            rank = np.empty(len(ids), np.int64)
            rank[sorted(range(len(ids)), key=orders.__getitem__)] = np.arange(len(ids))
            texts = b.column(2).cast(pa.large_binary()).to_pylist()
            for k, text in enumerate(texts):
                mark, order = hashlib.blake2b(text, digest_size=16).digest(), orders[k]
                first = met.get(mark)
                if first is not None and first <= order:
                    texts[k] = b""
                else:
                    met[mark] = order
            for numbers, shifts, raw, offsets in _stretches(texts, size):
                key, digest, doc, start, windows, offset = pieces_of(raw, offsets, size, core)
                row = np.array(numbers)[doc]
                place = _pack(start + np.array(shifts)[doc], windows, offset)
                by = np.lexsort((place, rank[row], digest, key))
                known = np.zeros(len(key), bool)
                known[by[1:]] = (key[by[1:]] == key[by[:-1]]) & (digest[by[1:]] == digest[by[:-1]])
                take = pa.array(row)
                hidden = np.where(known, 0, key.view(np.int64)), np.where(known, 0, digest.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(hidden[0]), pa.array(hidden[1]), b.column(0).take(take), b.column(1).take(take), pa.array(place), pa.array(known)], names=schema.names)

    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("id", id_type), T.StructField("tie", T.LongType()), T.StructField("place", T.LongType()),
                           T.StructField("known", T.BooleanType())])
    return rows.mapInArrow(run, schema)


# -- one anchor's pieces --------------------------------------------------------

def _runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of sorted rows, none empty, with two masks: the row's first ``keys``
    columns differ from the row before; the row's first column differs."""
    last: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        change = []
        for c in range(keys):
            v = b.column(c).to_numpy(zero_copy_only=False)
            change.append(np.concatenate([[last is None or v[0] != last[c]], v[1:] != v[:-1]]))
        last = [b.column(c)[b.num_rows - 1].as_py() for c in range(keys)]
        yield b, np.logical_or.reduce(change), change[0]


def _once(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows without those that equal the row before in the first ``keys`` columns."""
    last: list | None = None
    for b in batches:
        if not b.num_rows:
            continue
        again = np.zeros(b.num_rows, bool)
        again[1:] = True
        for c in b.columns[:keys]:
            now, before = c.slice(1), c.slice(0, b.num_rows - 1)
            same = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
            again[1:] &= same.to_numpy(zero_copy_only=False)
        again[0] = last == [c[0].as_py() for c in b.columns[:keys]]
        last = [c[b.num_rows - 1].as_py() for c in b.columns[:keys]]
        yield b.filter(pa.array(~again))


def _marks(pieces: DataFrame, repeated: bool) -> DataFrame:
    """The rows of anchors that are met more than once: ``anchor`` null where an
    equal piece comes earlier, else set, but only if the anchor has different pieces.
    With ``repeated`` rows, the same piece of the same row counts once."""
    first = ["anchor", "digest", "id", "tie", "place", "known"]
    dealt = F.when(F.col("known"), F.xxhash64("id", "tie", "place")).otherwise(F.col("anchor"))  # known repeats go anywhere
    rows = (pieces.select(*first, *[c for c in pieces.columns if c not in first]).repartition(dealt)
            .sortWithinPartitions("known", "anchor", "digest", F.col("id").asc_nulls_last(), "tie", "place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None  # the anchor's first piece, while no other is met
        def settled(b: pa.RecordBatch) -> pa.RecordBatch:
            return b.set_column(0, "anchor", pa.nulls(b.num_rows, pa.int64()))

        def unknown() -> Iterator[pa.RecordBatch]:
            for b in _once(batches, 5) if repeated else batches:
                held.append(settled(b.filter(b.column(5))))
                yield b.filter(pc.invert(b.column(5)))

        held: list[pa.RecordBatch] = []
        for b, new, new_anchor in _runs_of(unknown(), 2):
            out, held[:] = list(held), []
            repeats = b.filter(pa.array(~new))
            if repeats.num_rows:
                out.append(settled(repeats))
            firsts = np.flatnonzero(new)
            if len(firsts):
                opens = new_anchor[firsts]
                if waiting is not None and not opens[0]:
                    out.append(waiting)
                closes = np.append(opens[1:], True)  # the anchor's last piece so far
                lone = opens & closes
                out.append(b.take(pa.array(firsts[~lone])))
                waiting = b.slice(int(firsts[-1]), 1) if lone[-1] else None
            for x in out:
                if x.num_rows:
                    yield x
        yield from (x for x in held if x.num_rows)

    return rows.mapInArrow(run, rows.schema)


def _halves(size: int, core: int) -> tuple[int, int]:
    """How far the core grows to the right, or else to the left."""
    right = -(-(size - core) // 2)
    return right, size - core - right + 1


def _parts(text: bytes, at: int, core: int, size: int) -> Iterator[tuple[int, int, bytes, int, int]]:
    """A piece as its windows that reach far to the right of the core and the
    rest: side, first window, bytes, start and length of the grown core."""
    right, left = _halves(size, core)
    windows = len(text) - size + 1
    cut = max(at + core + right - size, 0)
    if cut < windows:
        yield 1, cut, text[cut:], at - cut, core + right
    if cut:
        yield 0, 0, text[:min(cut, windows) - 1 + size], at - left, core + left


class _Sorter:
    """Collects parts of many anchors and sorts their suffixes together."""

    def __init__(self, size: int, symbols: int = 1 << 16):
        self.size, self.most = size, symbols
        self.out: list[tuple[int, int, int]] = []  # (piece, first window, windows)
        self.clear()

    def clear(self) -> None:
        self.s: list[int] = []
        self.starts: list[tuple[int, int, int, int, int]] = []  # place in s, piece, first window, windows, symbols of a window
        self.cores = 0

    def group(self, members: list[tuple[int, bytes, int, int]]) -> None:
        """One anchor: (piece, bytes, offset and length of the core), in order of origin."""
        size, shared = self.size, {}
        for piece, text, at, core in members:
            if core >= size:  # the whole window is the core: pieces are equal
                shared.setdefault((0, text), []).append((piece, 0, text, 0, core))
                continue
            for side, first, part, start, grown in _parts(text, at, core, size):
                shared.setdefault((side, part[start:start + grown]), []).append((piece, first, part, start, grown))
        for parts in shared.values():
            if len(parts) < 2:
                continue
            different: set[bytes] = set()
            kept = []
            for x in parts:
                if x[2] in different:
                    self.out.append((x[0], x[1], len(x[2]) - size + 1))
                else:
                    different.add(x[2])
                    kept.append(x)
            if len(kept) < 2:
                continue
            symbol = 258 + self.cores
            self.cores += 1
            for piece, first, part, start, grown in kept:
                self.starts.append((len(self.s), piece, first, len(part) - size + 1, size + 1 - grown))
                self.s.extend(c + 2 for c in part[:start])
                self.s.append(symbol)
                self.s.extend(c + 2 for c in part[start + grown:])
                self.s.append(1)
        if len(self.s) >= self.most:
            self.flush()

    def flush(self) -> None:
        """Sorts what is held; adds the windows that are not the first of their string."""
        if not self.s:
            return
        order = np.array(suffix_array([*self.s, 0]), np.int64)
        s = np.array(self.s, np.int32)
        owner, length = np.full(len(s) + 1, -1), np.zeros(len(s) + 1, np.int64)
        for k, (at, _, _, windows, symbols) in enumerate(self.starts):
            owner[at:at + windows] = k
            length[at:at + windows] = symbols
        repeat = np.zeros(len(s) + 1, bool)
        for symbols in np.unique(length[length > 0]):
            at = order[length[order] == symbols]
            rows = s[at[:, None] + np.arange(symbols)]
            equal = (rows[1:] == rows[:-1]).all(axis=1)
            begin = np.flatnonzero(np.concatenate([[True], ~equal]))
            first = np.minimum.reduceat(at, begin)  # parts stand in order of origin
            later = at != np.repeat(first, np.diff(np.append(begin, len(at))))
            repeat[at[later]] = True
        places = np.flatnonzero(repeat)
        if len(places):
            breaks = np.flatnonzero((np.diff(places) != 1) | (np.diff(owner[places]) != 0)) + 1
            for run in np.split(places, breaks):
                at, piece, first, _, _ = self.starts[owner[run[0]]]
                self.out.append((piece, first + int(run[0]) - at, len(run)))
        self.clear()


def _repeats(pieces: DataFrame, size: int, id_type: T.DataType) -> DataFrame:
    """``(id, tie, start, windows)``: runs of repeated windows among the different pieces of each anchor."""
    rows = (pieces.select("anchor", "id", "tie", "place", "core", "bytes").repartition("anchor")
            .sortWithinPartitions("anchor", F.col("id").asc_nulls_last(), "tie", "place"))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("tie", T.LongType()), T.StructField("start", T.LongType()), T.StructField("windows", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorter, members, last = _Sorter(size), [], None
        held: list[tuple] = []  # (id, tie, start) of the pieces in the sorter

        def result() -> pa.RecordBatch:
            out = sorter.out
            got = pa.RecordBatch.from_pylist([{"id": held[k][0], "tie": held[k][1], "start": held[k][2] + first, "windows": n} for k, first, n in out], schema=arrow)
            sorter.out = []
            return got

        arrow = None
        for b in batches:
            if arrow is None:
                arrow = pa.schema([("id", b.schema.field("id").type), ("tie", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])
            for anchor, i, tie, place, core, text in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != last:
                    sorter.group(members)
                    members = []
                    last = anchor
                    if not sorter.s and len(held) > 4096:  # all that was held is sorted
                        yield result()
                        held = []
                members.append((len(held), text, place & 255, core))
                held.append((i, tie, place >> 16))
        if arrow is not None:
            sorter.group(members)
            sorter.flush()
            yield result()

    return rows.mapInArrow(run, schema)


def _grown(pieces: DataFrame, size: int, id_type: T.DataType) -> DataFrame:
    """Pieces of too many kinds as their two parts, each under its grown core."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("id", id_type), T.StructField("tie", T.LongType()),
                           T.StructField("place", T.LongType()), T.StructField("known", T.BooleanType()), T.StructField("core", T.IntegerType()), T.StructField("bytes", T.BinaryType())])
    short = lambda *x: int.from_bytes(hashlib.blake2b(b"".join(x), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for anchor, i, tie, place, core, text in zip(*(c.to_pylist() for c in b.columns)):
                for side, first, part, start, grown in _parts(text, place & 255, core, size):
                    head = anchor.to_bytes(8, "little", signed=True) + bytes([side])
                    out.append((short(head, part[start:start + grown]), short(part), i, tie, (((place >> 16) + first) << 16) | ((len(part) - size + 1) << 8) | start, False, grown, part))
            types = [pa.int64(), pa.int64(), b.schema.field("id").type, pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=schema.names)

    return pieces.select("anchor", "id", "tie", "place", "core", "bytes").mapInArrow(run, schema)


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["tie"] == b["tie"])


def _fetch(wanted: DataFrame, rows: DataFrame, size: int, core: int) -> DataFrame:
    """``(anchor, id, tie, place, core, bytes)``: the wanted pieces with their bytes."""
    asked = wanted.groupBy("id", "tie").agg(F.collect_list(F.struct("anchor", "place")).alias("asked"))
    both = rows.join(asked, _same_row(rows, asked)).select(rows["id"], rows["tie"], rows["text"], "asked")
    utf8 = F.encode("text", "UTF-8")
    one = both.select("id", "tie", utf8.alias("raw"), "asked").select("id", "tie", F.transform("asked", lambda x: F.struct(
        x["anchor"].alias("anchor"), x["place"].alias("place"),
        F.substring(F.col("raw"), (F.shiftright(x["place"], 16) + 1).cast("int"), (F.shiftright(x["place"], 8).bitwiseAND(F.lit(255)) + (size - 1)).cast("int")).alias("bytes"))).alias("got"))
    return one.select("id", "tie", F.explode("got").alias("g")).select("g.anchor", "id", "tie", "g.place", F.lit(core).alias("core"), "g.bytes")


# -- the operator -----------------------------------------------------------------

def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100, core: int | None = None,
                   max_pieces: int = 16_384) -> DataFrame:
    """``(id, n_bytes, spans, kept)`` of every row: the removed spans ``(start,
    end)`` in bytes, maximal and in order, and the remaining bytes."""
    size, core = min_bytes, core or max(1, min_bytes * 2 // 5)
    if not 2 <= size <= 200:
        raise ValueError("min_bytes must be 2 to 200")
    id_type = type_of(docs, id_col)
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    repeated = not base.groupBy("id").count().filter("count > 1").isEmpty()
    rows = base.select("id", (F.xxhash64("text") if repeated else F.lit(0).cast("long")).alias("tie"), "text")

    # equal texts
    slim = rows.select("id", "tie", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    classes = slim.groupBy("id", "tie", "sha", "n_bytes").agg(F.count("*").alias("n"))
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("tie"))
    first = classes.groupBy(F.col("sha").alias("of")).agg(F.min(order).alias("first"), F.count("*").alias("kinds")).filter("kinds > 1")
    classes = (classes.join(first, classes["sha"] == first["of"], "left")
               .select("id", "tie", "n_bytes", "n", (F.col("first").isNotNull() & ~F.coalesce(order == F.col("first"), F.lit(False))).alias("copy")))
    classes = materialise(classes, "equal-texts")

    # different pieces of one anchor
    marks = materialise(_marks(_anchors(rows, size, core, id_type), repeated), "pieces")
    window_count = F.shiftright("place", 8).bitwiseAND(F.lit(255)).cast("long").alias("windows")
    equal = lambda m: m.filter("anchor is null").select("id", "tie", F.shiftright("place", 16).alias("start"), window_count)
    runs = equal(marks)
    pieces = _fetch(marks.filter("anchor is not null"), rows, size, core)
    pieces = materialise(pieces.distinct() if repeated else pieces, "piece-bytes")
    while True:
        hot = materialise(pieces.groupBy("anchor").count().filter(F.col("count") > max_pieces).select("anchor"), "hot-anchors")
        if hot.isEmpty():
            runs = runs.unionByName(_repeats(pieces, size, id_type))
            break
        runs = runs.unionByName(_repeats(pieces.join(hot, "anchor", "left_anti"), size, id_type))
        marks = materialise(_marks(_grown(pieces.join(hot, "anchor", "left_semi"), size, id_type), False), "grown-pieces")
        runs, pieces = runs.unionByName(equal(marks)), marks.filter("anchor is not null")

    # cut
    found = runs.groupBy("id", "tie").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("windows") + (size - 1)).alias("end"))).alias("runs"))
    asked = classes.join(found, _same_row(classes, found), "left").select(classes["id"], classes["tie"], "n", "copy", "runs")
    both = rows.join(asked, _same_row(rows, asked)).select(rows["id"], rows["tie"], rows["text"], "n", "copy", "runs")
    cut = _cut(both, size, id_type)
    if repeated:
        once = cut.filter("n > 1").dropDuplicates(["id", "tie"])
        again = classes.filter("n > 1").select("id", "tie", "n_bytes", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("n"))
        span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        texts = cut.filter("n > 1 and n_bytes < " + str(size)).select("id", "tie", F.col("kept").alias("short")).dropDuplicates(["id", "tie"])
        again = (again.join(texts, _same_row(again, texts), "left")
                 .select(again["id"], again["tie"], "n_bytes", F.when(F.col("n_bytes") >= size, span).otherwise(F.slice(span, 1, 0)).alias("spans"),
                         F.coalesce("short", F.lit(b"")).alias("kept"), "n"))
        cut = cut.filter("n = 1").unionByName(once).unionByName(again)
    return cut.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")


def _cut(both: DataFrame, size: int, id_type: T.DataType) -> DataFrame:
    """Rows with their runs merged and the remaining bytes."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", id_type), T.StructField("tie", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", spans),
                           T.StructField("kept", T.BinaryType()), T.StructField("n", T.LongType())])

    def merged(text: bytes, copy: bool, runs: pa.Scalar) -> list[tuple[int, int]]:
        if copy:
            return [(0, len(text))] if len(text) >= size else []
        if not runs.is_valid or not len(runs.values):
            return []
        start, end = (runs.values.field(k).to_numpy() for k in (0, 1))
        by = np.argsort(start, kind="stable")
        start, end = start[by], np.maximum.accumulate(end[by])
        begin = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        return list(zip(start[begin].tolist(), end[np.append(begin[1:], len(start)) - 1].tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in small_batches(batches, 2):
            texts = b.column(2).cast(pa.large_binary()).to_pylist()
            all_spans, kept = [], []
            for text, copy, runs in zip(texts, b.column(4).to_pylist(), b.column(5)):
                cuts = merged(text, copy, runs)
                edges = [0, *(x for c in cuts for x in c), len(text)]
                kept.append(b"".join(text[edges[k]:edges[k + 1]] for k in range(0, len(edges), 2)))
                all_spans.append([{"start": s, "end": e} for s, e in cuts])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array(all_spans, pa.list_(struct)),
                                              pa.array(kept, pa.binary()), b.column(3)], names=schema.names)

    return both.select("id", "tie", "text", "n", "copy", "runs").mapInArrow(run, schema)
