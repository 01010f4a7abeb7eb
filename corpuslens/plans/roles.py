"""How the driver's tables play the roles the evaluation operators expect.

``documents`` is split into a synthetic side (sources src10..src19) and a
real side (the rest); entities are one to four words of each ``benchmark`` item;
labels/lengths give classifier predictions; ``conversations`` give coref
clusterings; ``embeddings`` split into two corpora by id parity.
Each function reads whole tables; nothing is sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Tables of long texts: a file that is one row group would be one task.
TEXT_TABLES = {"documents", "conversations", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; a text table that comes in fewer partitions than there are
    cores is dealt out to all of them (the caller's choice, not the library's)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores else df


def is_syn() -> F.Column:
    return F.substring(F.col("source"), 4, 10).cast("int") >= 10


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def syn_docs(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).filter(is_syn()).select("doc_id", "text")


def ref_docs(spark, sf_dir) -> DataFrame:
    return documents(spark, sf_dir).filter(~is_syn()).select("doc_id", "text")


def entities(spark, sf_dir) -> DataFrame:
    """Of each item one to four words (by its id), from its longest word on."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    first = F.slice("w", 1, F.greatest(F.size("w") - 3, F.lit(1)))
    long = F.reduce(first, F.lit(""), lambda a, x: F.when((F.length(x) > F.length(a)) | ((F.length(x) == F.length(a)) & (x < a)), x).otherwise(a))
    n = (F.col("item_id") % 4 + 1).cast("int")
    return b.select(F.col("item_id").alias("entity_id"),
                    F.array_join(F.slice("w", F.array_position(first, long).cast("int"), n), " ").alias("entity"))


def gazetteer(spark, sf_dir) -> DataFrame:
    """(entity, label): of each item a name of one to six words around its longest
    word, one that begins inside it, and its first two words."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " "))
    long = F.reduce("w", F.lit(""), lambda a, x: F.when((F.length(x) > F.length(a)) | ((F.length(x) == F.length(a)) & (x < a)), x).otherwise(a))
    b = b.withColumn("at", F.greatest(F.least(F.array_position("w", long).cast("int"), F.size("w") - 6), F.lit(1)))
    name = lambda start, n, label: F.struct(F.array_join(F.slice("w", start, n), " ").alias("entity"), F.lit(label).alias("label"))
    at, i = F.col("at"), F.col("item_id")
    return b.select(F.explode(F.array(name(at, (i % 6 + 1).cast("int"), "whole"), name(at + 1, (i * 7 % 5 + 1).cast("int"), "inner"), name(at, F.lit(2), "head"))).alias("n")).select("n.*")


def single_label_predictions(spark, sf_dir) -> DataFrame:
    """ground = quality label, predicted = long-document rule, subgroup = lang."""
    lab = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "n_chars")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").alias("ground"),
        (F.col("n_chars") > 1500).cast("int").alias("predicted"),
        F.col("lang").alias("subgroup"),
    )


def multilabel_predictions(spark, sf_dir) -> DataFrame:
    """ground = {0 if quality, 1 if toxic}; predicted from length rules; 3 classes."""
    lab = table(spark, sf_dir, "labels")
    docs = documents(spark, sf_dir).select("doc_id", "lang", "n_chars")
    j = lab.join(docs, "doc_id")
    ground = F.filter(F.array(F.when(F.col("quality") == 1, F.lit(0)),
                              F.when(F.col("toxic") == 1, F.lit(1))), lambda x: x.isNotNull())
    predicted = F.filter(F.array(F.when(F.col("n_chars") > 1500, F.lit(0)),
                                 F.when(F.col("n_chars") % 3 == 0, F.lit(1)),
                                 F.when(F.col("n_chars") < 300, F.lit(2))), lambda x: x.isNotNull())
    return j.select(F.col("doc_id").alias("id"), ground.alias("ground"),
                    predicted.alias("predicted"), F.col("lang").alias("subgroup"))


def coref_gold(spark, sf_dir) -> DataFrame:
    """mention = turn; gold cluster = role, per conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_key"), F.col("role").alias("cluster"),
                    F.col("turn").alias("start"), F.col("turn").alias("end"))


def coref_pred(spark, sf_dir) -> DataFrame:
    """predicted cluster = length(text) mod 3."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_key"),
                    (F.length("text") % 3).cast("string").alias("cluster"),
                    F.col("turn").alias("start"), F.col("turn").alias("end"))
