"""Product-quantised vector codes with equal-average nearest-entry search.

Vectors become integers (floor of ``scale * x``) and are cut into equal parts;
each part position has a codebook of at most ``entries`` rows, refined by rounds
of assignment and integer means. The nearest entry of a part is found without
computing all distances: entries are sorted by component sum, and the search
goes outward from the part's own sum on both sides. By Cauchy-Schwarz the
squared distance is at least the squared gap of the sums over the dimension, so
a side ends as soon as that bound strictly exceeds the best distance.

The integer vectors are written once. A round is one pass over them: tasks hold
the codebooks (``parts * entries * width`` numbers, whatever the table's size)
and return one sum and count per entry and component, which Spark adds up; only
those totals reach the driver.

Defined results: rows whose vector is null or holds a null or non-finite
component take no part, nor do vectors of another length than the first one's
(by id, nulls last, then components); a length that the parts do not divide is
an error; null and repeated ids are coded like others and stand in the first
codebooks in the same order; with fewer rows than ``entries`` the codebooks are
as small; ties go to the lower entry; components beyond 64 bits, errors and
their sums stop at the 64-bit limits; an empty table gives no rows and empty
codebooks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import type_of

_MOST = 2 ** 63 - 1
Books = list[np.ndarray]


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 1024) -> DataFrame:
    """``(id, label, v)`` of the rows that take part, written to the scratch folder."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.filter(vec.isNotNull() & F.forall(vec, finite)).select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.transform(vec, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    rows = materialise(rows, "integer-vectors")
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    return rows.filter(F.size("v") == (first[0] if first else 0))


# -- equal-average search -------------------------------------------------------

def _exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as the shortest integers in which no square or sum can overflow."""
    most = max([abs(int(x)) for a in arrays if a.size for x in (a.max(), a.min())], default=0)
    bits = ((2 * (most + 1) * max(1, arrays[0].shape[1])) ** 2).bit_length()
    return [a.astype(np.int32 if bits < 31 else np.int64 if bits < 63 else object) for a in arrays]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to each row's nearest entry, ties to the lower index."""
    n, width = x.shape
    x, book = _exact(x, book)
    sums, entry_sums = x.sum(axis=1, dtype=x.dtype), book.sum(axis=1, dtype=x.dtype)
    order = np.array(sorted(range(len(book)), key=lambda j: (int(entry_sums[j]), j)))
    sorted_sums, sorted_book = entry_sums[order], book[order]
    right = np.searchsorted(sorted_sums, sums)
    left = right - 1
    best, index = np.zeros(n, x.dtype), np.full(n, -1)

    def look(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tries one entry for each row; which rows may go on in this direction."""
        gap = sorted_sums[at] - sums[rows]
        go = (index[rows] < 0) | ~(gap * gap > best[rows] * width).astype(bool)
        rows, at = rows[go], at[go]
        off = x[rows] - sorted_book[at]
        d, j = (off * off).sum(axis=1) if off.dtype == object else np.einsum("ij,ij->i", off, off), order[at]
        better = (index[rows] < 0) | (d < best[rows]).astype(bool) | ((d == best[rows]).astype(bool) & (j < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], j[better]
        return rows

    up, down = np.arange(n), np.arange(n)
    while len(up) or len(down):
        up = up[right[up] < len(book)]
        up = look(up, right[up]) if len(up) else up
        right[up] += 1
        down = down[left[down] >= 0]
        down = look(down, left[down]) if len(down) else down
        left[down] -= 1
    return index, best


# -- codebooks --------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            yield part, _matrix(part.column(column))


def _totals(rows: DataFrame, books: Books) -> DataFrame:
    """``(part, entry, at, n, total)``: the members of each entry and the sum of each component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for _, x in _blocks(batches, 0):
            for p, book in enumerate(books):
                part = x[:, p * width:(p + 1) * width]
                index, _ = nearest(part, book)
                counts[p] += np.bincount(index, minlength=len(book))
                if part.size and max(abs(int(part.max())), abs(int(part.min()))) * len(part) >= 2 ** 62:
                    part = part.astype(object)
                sums = np.zeros(book.shape, part.dtype)
                np.add.at(sums, index, part)
                totals[p] += sums.astype(object)
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(used) * width, p, np.int32)), pa.array(np.repeat(used, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                pa.array(np.repeat(n[used], width)), pa.array([int(t) for t in totals[p][used].ravel()], pa.decimal128(38, 0))], names=["part", "entry", "at", "n", "total"])

    return (rows.select("v").mapInArrow(run, "part int, entry int, at int, n long, total decimal(38,0)")
            .groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))


def fit(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Books:
    """The codebooks, one ``(entries, width)`` integer array a part."""
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not start:
        return []
    first = np.array([r[0] for r in start], np.int64).reshape(len(start), -1)
    if first.shape[1] % parts:
        raise ValueError(f"vectors of {first.shape[1]} components have no {parts} equal parts")
    books = [np.ascontiguousarray(b) for b in np.split(first, parts, axis=1)]
    for _ in range(rounds if books[0].shape[1] else 0):
        books = [b.copy() for b in books]
        for r in _totals(rows, books).collect():  # at most parts * entries * width rows
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def fingerprint(books: Books) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: Books) -> DataFrame:
    """``(id, label, code, error)``: each part's entry and the squared distance summed over the parts."""
    schema = T.StructType([T.StructField("id", type_of(rows, "id")), T.StructField("label", type_of(rows, "label")),
                           T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _blocks(batches, 2):
            width = books[0].shape[1]
            found = [nearest(x[:, p * width:(p + 1) * width], book) for p, book in enumerate(books)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.int32)
            error = sum(d.astype(object) for _, d in found)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(code), pa.list_(pa.int32())),
                                              pa.array([min(int(e), _MOST) for e in error], pa.int64())], names=schema.names)

    return rows.select("id", "label", "v").mapInArrow(run, schema) if books else rows.sparkSession.createDataFrame([], schema)


def decode(code: Column, books: Books) -> Column:
    """The integer vector that a code stands for."""
    lists = [F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in b]) for b in books]
    return F.concat(*[F.get(rows, F.get(code, F.lit(p))) for p, rows in enumerate(lists)])


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error of all rows of the label, nulls together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).drop("of")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = 1024,
             parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Books]:
    """The coded rows ``(id, label, code, error, label_error)``, written once, and the codebooks."""
    rows = integer_vectors(vectors, id_col, vec_col, label_col, scale)
    books = fit(rows, parts, entries, rounds)
    coded = materialise(encode(rows, books), "vector-codes")
    return label_errors(coded).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error"), books
