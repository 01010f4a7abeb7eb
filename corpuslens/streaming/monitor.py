"""Incremental leakage and filter monitoring with Structured Streaming.

Entity search and the discard filter are stateless per document, so the
batch operators apply unchanged to a streaming DataFrame: the entity table
is static (stream-static join, no state) and each micro-batch
is searched as it arrives. Output goes to any sink; the checkpoint lives
under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import discard_filter
from ..operators.search import entity_mentions
from ..session import ensure_checkpoint_dir


def document_stream(spark: SparkSession, path: str, schema, *, fmt: str = "parquet",
                    glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def leakage_stream(stream: DataFrame, entities: DataFrame, **kw) -> DataFrame:
    """Streaming (doc_id, entity_id, entity) hits; same semantics as the batch search."""
    return entity_mentions(stream, entities, **kw)


def filter_stream(stream: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """Streaming discard-filter audit: cleaned text, keep flag, reason."""
    return discard_filter(stream, text_col, **kw)


def start(df: DataFrame, name: str, *, path: str, sink: str = "parquet",
          available_now: bool = True, output_mode: str = "append"):
    """Start a query into files at ``path``, with a checkpoint under
    ``spark.checkpoint.dir/streams/<name>``."""
    base = ensure_checkpoint_dir(df.sparkSession)
    w = (df.writeStream.outputMode(output_mode).queryName(name)
         .option("checkpointLocation", os.path.join(base, "streams", name)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.format(sink).option("path", path).start()


def leakage_monitor(spark: SparkSession, path: str, schema, entities: DataFrame, out: str, name: str = "leakage",
                    glob: str | None = None):
    """Run the leakage search over all files in ``path`` (availableNow) into
    parquet files at ``out``; returns the finished query."""
    q = start(leakage_stream(document_stream(spark, path, schema, glob=glob), entities), name, path=out)
    q.awaitTermination()
    return q
