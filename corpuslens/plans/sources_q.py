"""Sources and sinks over written-back tables.

Each query writes a table in the reader's format to the session's scratch folder
and returns what the reader makes of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import corpus as SRC
from . import roles
from .catalog import register

_SPLITS = ("train", "validation", "test", "synthetic")


def _csv(df, path):
    SRC.write_result(df, path, fmt="csv")
    return path


@register("split_files", """
SELECT CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' ELSE 'synthetic' END AS split,
       CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, CAST(length(text) AS BIGINT) AS n FROM documents""")
def split_files(spark, sf):
    """Split files in CSV, line breaks in quoted fields, read in parallel."""
    docs = roles.documents(spark, sf).select("doc_id", F.concat("text", F.lit("")).alias("text"))
    base = scratch_path(spark, "splits")
    for k, name in enumerate(_SPLITS):
        _csv(docs.filter(F.col("doc_id") % 4 == k), f"{base}/{name}.csv")
    return SRC.read_splits(spark, base, _SPLITS).select("split", "doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))


@register("csv_ingest", """
SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1""")
def csv_ingest(spark, sf):
    """Two CSV files read as one corpus."""
    docs = roles.documents(spark, sf).select("doc_id", "text")
    base = scratch_path(spark, "ingest")
    paths = [_csv(docs.filter(F.col("doc_id") % 2 == k), f"{base}/part{k}.csv") for k in (0, 1)]
    return SRC.ingest_csvs(spark, paths, "text").groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@register("annotation_files", """
SELECT CAST(item_id AS VARCHAR) AS doc_id, length(text) AS n_chars, len(string_split(text, ' ')) AS n_mentions,
       string_split(text, ' ')[1] AS first_mention, CAST(1990 + item_id % 30 AS BIGINT) AS year FROM benchmark""")
def annotation_files(spark, sf):
    """Nested annotation records in JSON lines, read with their fixed schema."""
    b = roles.table(spark, sf, "benchmark")
    mention = F.transform(F.split("text", " "), lambda w: F.struct(F.lit("WORD").alias("entity_type"), F.lit("NO_MASK").alias("identifier_type"), w.alias("span_text")))
    records = b.select(F.col("item_id").cast("string").alias("doc_id"), "text", F.create_map(F.lit("a"), F.struct(mention.alias("entity_mentions"))).alias("annotations"),
                       F.struct(F.lit("UK").alias("countries"), (1990 + F.col("item_id") % 30).cast("int").alias("year")).alias("meta"))
    path = scratch_path(spark, "annotations")
    SRC.write_result(records, path, fmt="json")
    back = SRC.read_annotations(spark, path, multi_line=False)
    words = F.col("annotations")["a"]["entity_mentions"]
    return back.select("doc_id", F.length("text").alias("n_chars"), F.size(words).alias("n_mentions"), words[0]["span_text"].alias("first_mention"), "meta.year")


@register("result_appends", """
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
s AS (SELECT source AS lang, count(*) AS n FROM documents GROUP BY source)
SELECT 'by_lang' AS run_id, lang, n FROM c UNION ALL SELECT 'by_source', lang, n FROM s""")
def result_appends(spark, sf):
    """Two runs appended to a results table, the first of them tried twice."""
    docs = roles.documents(spark, sf)
    path = scratch_path(spark, "results")
    count = lambda c: docs.groupBy(F.col(c).alias("lang")).agg(F.count("*").alias("n"))
    for run, frame in (("by_lang", count("lang")), ("by_source", count("source")), ("by_lang", count("lang"))):
        SRC.append_result(frame, path, run)
    return SRC.read_results(spark, path).select("run_id", "lang", "n")
