"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def type_of(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def strings(column: pa.Array) -> list[str]:
    """The column's texts; a null text counts as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: int, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of text (or one row).

    Bounds what a task keeps while it works on vectors as long as the texts;
    every row passes through whole.
    """
    for b in batches:
        if not b.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > max_bytes:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        yield b.slice(start)
