"""CSV whose quoted fields hold line breaks, read in parallel.

A line begins a record if an even number of quotes stands before it in its file
(quotes inside fields are doubled, as RFC 4180 has it). Spark's text reader cuts
files into byte ranges at line ends; a first pass counts the quotes of each
range, prefix sums of these tell the state at every range's start, and a second
pass joins lines to records, range by range. Only the two ends of a range can
hold parts of a record of another range; those few parts are put together by a
grouped sort. A file of any size is read by as many tasks as it has ranges.

The table of ranges (one small row for ``spark.sql.files.maxPartitionBytes`` of
input) is gathered to the driver and sent with the second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of records: a whole one; its end, its middle or its beginning in this range; a file's first record.
WHOLE, END, MIDDLE, BEGIN, HEADER = range(5)


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    lines = spark.read.text(paths, lineSep="\n")
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _open_ranges(lines: DataFrame) -> dict[tuple[str, int], int]:
    """Whether each range of a file begins inside quotes."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"')))
    counted = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd")).collect()
    state: dict[tuple[str, int], int] = {}
    inside: dict[str, int] = {}
    for r in sorted(counted, key=lambda r: (r["file"], r["start"])):
        state[r["file"], r["start"]] = inside.get(r["file"], 0)
        inside[r["file"]] = (inside.get(r["file"], 0) + r["odd"]) % 2
    return state


class _Range:
    """One byte range of a file as its lines go by."""

    def __init__(self, key: tuple[str, int], inside: int):
        self.key, self.inside = key, inside
        self.held: list[str] = []  # lines of the record that is open
        self.first = HEADER if key[1] == 0 else END if inside else WHOLE  # what the open record will be

    def add(self, values: pa.Array) -> list[tuple[int, str]]:
        odd = pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2
        before = (self.inside + np.concatenate([[0], np.cumsum(odd)[:-1]])) % 2 if len(odd) else odd
        texts, out, at = values.to_pylist(), [], 0
        for k in [*np.flatnonzero(before == 0).tolist(), len(texts)]:
            if k:
                self.held += texts[at:k]
            if k < len(texts) and self.held:
                out.append((self.first, "\n".join(self.held)))
                self.held, self.first = [], WHOLE
            at = k
        self.inside = int(self.inside + odd.sum()) % 2
        return out

    def close(self) -> list[tuple[int, str]]:
        if not self.held:
            return []
        part = {WHOLE: BEGIN, END: MIDDLE, HEADER: HEADER}[self.first] if self.inside else self.first
        return [(part, "\n".join(self.held))]


def quoted_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, start, record): the records of the files as text, without each
    file's first (the header, which has to end in the first range); ``start`` is
    the byte range that a record begins in."""
    lines = _lines(spark, paths)
    state = _open_ranges(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None

        def batch(key: tuple[str, int], parts: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(parts), pa.string()), pa.array([key[1]] * len(parts), pa.int64()),
                                               pa.array([p for p, _ in parts], pa.int32()), pa.array([t for _, t in parts], pa.string())], names=["file", "start", "part", "record"])

        for b in batches:
            files, starts = b.column(1).to_pylist(), b.column(2).to_pylist()
            cuts = [0, *[k for k in range(1, b.num_rows) if (files[k], starts[k]) != (files[k - 1], starts[k - 1])], b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key = (files[lo], starts[lo])
                if now is None or now.key != key:
                    if now is not None:
                        yield batch(now.key, now.close())
                    now = _Range(key, state[key])
                yield batch(key, now.add(b.column(0).slice(lo, hi - lo)))
        if now is not None:
            yield batch(now.key, now.close())

    parts = lines.mapInArrow(run, "file string, start long, part int, record string")
    whole = parts.filter(F.col("part") == WHOLE).select("file", "start", "record")
    return whole.unionByName(_joined(parts.filter(F.col("part").isin(END, MIDDLE, BEGIN))))


def _joined(parts: DataFrame) -> DataFrame:
    """Records whose parts lie in several ranges (two parts a range at most)."""
    order = Window.partitionBy("file").orderBy("start", "part")  # an END stands before the BEGIN of its range
    number = F.sum(F.when(F.col("part") == BEGIN, 1).otherwise(0)).over(order)
    lists = parts.withColumn("record_no", number).groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("l"))
    return lists.select("file", F.col("l")[0]["start"].alias("start"), F.array_join(F.transform("l", lambda x: x["record"]), "\n").alias("record"))


def _header(spark: SparkSession, paths: str | list[str]) -> list[str]:
    line = spark.read.text(paths, lineSep="\n").first()
    if line is None:
        return []
    text = F.lit(line[0].rstrip("\r").lstrip("﻿"))
    row = spark.range(1).select(F.from_csv(text, ", ".join(f"c{k} string" for k in range(line[0].count(",") + 1)), {"escape": '"'}).alias("r")).first()[0]
    return [v for v in row if v is not None]


def read_quoted_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, *, drop_malformed: bool = False) -> DataFrame:
    """The rows of CSV files with a header, fields quoted by ``"`` (doubled inside).

    Without a schema all columns are strings named by the first file's header.
    Empty lines are skipped; short and long records are filled or cut as Spark's
    reader does, or left out with ``drop_malformed``.
    """
    if schema is None:
        names = _header(spark, paths)
        if not names:
            return spark.createDataFrame([], T.StructType([]))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    text = F.regexp_replace("record", r"\r\z", "")
    records = quoted_records(spark, paths).select(text.alias("record")).filter(F.col("record") != "")
    fields = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed", "multiLine": "true"}
    rows = records.select(F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.fields), options).alias("r"))
    if drop_malformed:
        rows = rows.filter(F.col("r._malformed").isNull())
    return rows.select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields])
