"""Sources and sinks: corpora from CSV / parquet / JSON / in-memory frames,
split directories, nested annotation and coref JSON, result writers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import ordered_rank
from ..session import join_scalars
from .quoted_csv import read_quoted_csv


def load_corpus(spark: SparkSession, src, fmt: str = "parquet", *, text_col: str = "text",
                id_col: str = "doc_id", schema=None, multi_line: bool = False) -> DataFrame:
    """(doc_id, text) from a path (csv / parquet / json) or a DataFrame.

    CSV is read with a header and ``"`` escapes; fields with line breaks need
    ``multi_line`` (two passes, still in parallel, see ``quoted_csv``). JSON needs a schema. A missing id column is derived with ``monotonically_increasing_id`` (unique,
    not consecutive). The text column must be a string; NULL texts are dropped.
    """
    if isinstance(src, DataFrame):
        df = src
    elif fmt == "csv" and multi_line:
        df = read_quoted_csv(spark, src, schema)
    elif fmt == "csv":
        r = spark.read.option("header", True).option("escape", '"')
        df = (r.schema(schema) if schema is not None else r).csv(src)
    elif fmt == "json":
        if schema is None:
            raise ValueError("JSON needs a schema: inferring one reads the whole corpus")
        df = spark.read.json(src, schema=schema)
    else:
        df = spark.read.parquet(src)
    if not isinstance(df.schema[text_col].dataType, T.StringType):
        raise TypeError(f"text column {text_col!r} must be a string")
    if id_col not in df.columns:
        df = df.withColumn(id_col, F.monotonically_increasing_id())
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())


def read_splits(spark: SparkSession, base: str, splits=("train", "validation", "test", "synthetic"),
                fmt: str = "csv") -> DataFrame:
    """Union of ``<base>/<split>.<fmt>`` files with a ``split`` column."""
    frames = []
    for s in splits:
        path = f"{base.rstrip('/')}/{s}.{fmt}"
        df = read_quoted_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)
        frames.append(df.withColumn("split", F.lit(s)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


MENTION = T.StructType([T.StructField("entity_type", T.StringType()),
                        T.StructField("identifier_type", T.StringType()),
                        T.StructField("span_text", T.StringType())])
ANNOTATED = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("annotations", T.MapType(T.StringType(), T.StructType([
        T.StructField("entity_mentions", T.ArrayType(MENTION))]))),
    T.StructField("meta", T.StructType([T.StructField("countries", T.StringType()),
                                        T.StructField("year", T.IntegerType())])),
])


def read_annotations(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Annotated records with an explicit nested schema (no inference)."""
    return spark.read.schema(ANNOTATED).option("multiLine", multi_line).json(path)


COREF_DOC = T.StructType([
    T.StructField("doc_key", T.StringType()),
    T.StructField("sentences", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("speakers", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("constituents", T.ArrayType(T.StringType())),
    T.StructField("ner", T.ArrayType(T.StringType())),
    T.StructField("clusters", T.ArrayType(T.ArrayType(T.ArrayType(T.IntegerType())))),
])


def read_coref_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COREF_DOC).json(path)


def coref_mentions(docs: DataFrame) -> DataFrame:
    """Nested clusters -> (doc_key, cluster, start, end, pos)."""
    c = docs.select("doc_key", F.posexplode("clusters").alias("cluster", "_c"))
    return c.select("doc_key", "cluster", F.posexplode("_c").alias("pos", "_m")).select(
        "doc_key", "cluster", F.col("_m")[0].alias("start"), F.col("_m")[1].alias("end"), "pos")


def ingest_csvs(spark: SparkSession, paths: list[str], text_col: str, *, sample_size: int = -1,
                seed: int = 0) -> DataFrame:
    """Several CSV files, malformed lines dropped, seeded order, first
    ``sample_size`` rows (-1 = all)."""
    for p in paths:
        if not p.endswith(".csv"):
            raise ValueError(f"not a .csv file: {p}")
    df = read_quoted_csv(spark, paths, drop_malformed=True)
    df = df.filter(F.col(text_col).isNotNull()).withColumn(
        "_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(text_col))))
    df = df.orderBy("_key")
    return (df.limit(sample_size) if sample_size >= 0 else df).drop("_key")


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)  # as the readers expect it
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def append_result(df: DataFrame, path: str, run_id: str | None = None, fmt: str = "parquet") -> None:
    """Add one run's rows to a results table (created on first write).

    With a ``run_id`` the table is partitioned by it and a run's partition is
    replaced whole: a job that is tried again leaves its rows once, and runs that
    write at the same time do not touch one another. Without, rows are appended.
    """
    if run_id is None:
        write_result(df, path, fmt, mode="append")
        return
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError("run_id must consist of letters, digits, '_', '.' and '-'")
    write_result(df, f"{path.rstrip('/')}/run_id={run_id}", fmt)


def read_results(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """All runs of a results table, with ``run_id`` as text."""
    reader = spark.read.option("basePath", path).option("header", True)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.format(fmt).load(f"{path.rstrip('/')}/run_id=*").withColumn("run_id", F.col("run_id").cast("string"))


def align_corpora(syn: DataFrame, real: DataFrame, *, max_real_chars: int | None = 3000,
                  id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Drop long real texts, then keep the first n rows (by id) of each side,
    n = the smaller size. Adds ``position`` (1-based, by id)."""
    if max_real_chars is not None:
        real = real.filter(F.length(text_col) < max_real_chars)
    rs, rr = (ordered_rank(d, id_col, rank_col="position") for d in (syn, real))
    n = join_scalars(syn.agg(F.count("*").alias("a")), real.agg(F.count("*").alias("b"))).select(
        F.least("a", "b").alias("_n"))
    keep = lambda d: join_scalars(d, n).filter(F.col("position") <= F.col("_n")).drop("_n")
    return keep(rs), keep(rr)
