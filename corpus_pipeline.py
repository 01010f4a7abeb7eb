"""From raw documents to a training mix: five stages, each on all that its
predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)``
and returns a DataFrame. ``run`` writes each stage's result to the shared scratch
folder and reads it back, so a lost executor costs one stage's tasks at most.

Texts are shuffled by near_duplicates and decontamination, once each, to meet the
list of documents that stay or go (again in near_duplicates if rows repeat); the
other stages filter or rewrite rows where they lie.

Null ids: such rows are judged by their text in all stages; near_duplicates keeps
one only where its group has no id. Repeated rows are one document after
near_duplicates, and so are near-equal texts of one id. Empty tables give empty results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, quality_pu, secret_scan, simhash_dedup, source_mixing
from corpuslens.llm.common import fresh_name, id_fold, table
from corpuslens.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores 0.3 or more."""
    training = F.col("doc_id").isNotNull() & (id_fold("doc_id", 5) != 0)
    model = quality_pu.fit(quality_pu.featurise(docs), table(spark, sf_dir, "labels"), training)
    return quality_pu.keep(docs, model, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash group: the smallest by id (null last), then by the text's hash."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text_key"))
    fps = simhash_dedup.fingerprints(docs.select(row.alias("row"), "text"), "row", shingle_words=3)
    rooted = simhash_dedup.fingerprint_roots(fps.groupBy("fp").agg(F.min("row").alias("first")), max_distance=2)
    kept = rooted.groupBy("root").agg(F.min("first").alias("row")).select(F.col("row.doc_id").alias("kept_id"), F.col("row.text_key").alias("kept_key"))
    kept = materialise(kept, "kept")
    found = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_key"]), "left_semi")
    rows = materialise(docs.select("doc_id", F.xxhash64("text").alias("text_key")), "row-keys")
    if rows.groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty():
        return found
    key = fresh_name(docs, "text_key")  # repeated rows: one of them stays
    return found.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).drop(key)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    bad = materialise(found.select(F.col("doc_id").alias("bad_id"), "text_key").distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"]), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets of every layer; n_chars follows the text."""
    masked = secret_scan.redact(docs)
    count = F.coalesce(F.char_length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", count)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document's words taken and its training positions."""
    mixed = source_mixing.mix(docs)
    at = lambda k: F.get("passes", F.lit(k))["position"]
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", at(0).alias("position"), at(1).alias("second_position"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("mixing", mixing)]

#: Hashes (XXH64) and a fitted classifier are beyond DuckDB's SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
