"""Seeded ranks, exact-size splits and samples without a single-partition window.

A row's random key is ``md5("<seed>:<id>")`` (hex), reproducible in any SQL
engine. A global rank over that key is computed per hash-prefix bucket
(``16^prefix`` buckets, uniformly filled because md5 is uniform): bucket counts
are a bounded table whose running sum gives each bucket's offset; inside a
bucket a window ranks the rows. No task ever holds more than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_scalars, materialise


def seeded_key(id_col, seed: int | str = 42) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")))


def global_rank(df: DataFrame, key: Column, *, prefix: int = 3, rank_col: str = "rank") -> DataFrame:
    """Add a 1-based dense position ``rank_col`` by ascending hex ``key``.

    Keys must be unique (ties would be broken arbitrarily). ``prefix`` hex
    digits give 16^prefix buckets: 4096 by default, ~2.5 M rows per bucket at
    10^10 rows.
    """
    k = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, prefix))
    counts = k.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # at most 16^prefix rows: the running sum over it is a bounded window
    offsets = counts.select(
        "_bucket",
        (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    ranked = k.join(F.broadcast(offsets), "_bucket").withColumn(
        rank_col, F.coalesce("_off", F.lit(0)) + F.row_number().over(
            Window.partitionBy("_bucket").orderBy("_key")))
    return ranked.drop("_bucket", "_off", "_key")


def ordered_rank(df: DataFrame, order_col: str, *, rank_col: str = "rank") -> DataFrame:
    """Add the 1-based position of each row by ``order_col`` (unique, not null).

    The values are range-sorted and written with the number of their range; the
    ranges' counts give offsets, so no task ranks more than one range.
    """
    ranged = df.select(order_col).repartitionByRange(order_col).select(F.col(order_col).alias("_v"), F.spark_partition_id().alias("_part"))
    ranged = materialise(ranged, "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    place = ranged.join(F.broadcast(offsets), "_part").select("_v", (F.col("_off") + F.row_number().over(Window.partitionBy("_part").orderBy("_v"))).alias(rank_col))
    return df.join(place, df[order_col] == place["_v"]).drop("_v")


def split_sizes(n: Column, val_ratio: float, test_ratio: float) -> tuple[Column, Column]:
    """(n_val, n_test) as in scikit-learn's two-step train_test_split:
    held-out = ceil(n (val + test)), test = ceil(held-out * test / (val + test))."""
    held = F.ceil(n * F.lit(val_ratio + test_ratio))
    n_test = F.ceil(held * F.lit(test_ratio / (val_ratio + test_ratio)))
    return held - n_test, n_test


def exact_split(df: DataFrame, id_col: str, *, train_ratio: float = 0.8, val_ratio: float = 0.1,
                test_ratio: float = 0.1, seed: int = 42, split_col: str = "split") -> DataFrame:
    """Assign every row to train / validation / test with exact sizes.

    Test takes the first ranks by the seeded key, validation the next ones.
    """
    if abs(train_ratio + val_ratio + test_ratio - 1.0) > 1e-9:
        raise ValueError("train, validation and test shares have to add up to 1")
    ranked = global_rank(df, seeded_key(id_col, seed), rank_col="_r")
    n = df.agg(F.count("*").alias("_n"))
    n_val, n_test = split_sizes(F.col("_n"), val_ratio, test_ratio)
    sizes = n.select(n_val.alias("_nv"), n_test.alias("_nt"))
    out = join_scalars(ranked, sizes).withColumn(
        split_col,
        F.when(F.col("_r") <= F.col("_nt"), "test")
        .when(F.col("_r") <= F.col("_nt") + F.col("_nv"), "validation")
        .otherwise("train"))
    return out.drop("_r", "_nv", "_nt")


def nested_split(df: DataFrame, id_col: str, *, keep_ratio: float = 0.9, train_ratio: float = 0.95,
                 seed: int = 42, split_col: str = "split") -> DataFrame:
    """Generator split: ``keep_ratio`` of rows (rounded) kept, of which ``train_ratio``
    (rounded) is train and the rest eval; the remainder is test."""
    ranked = global_rank(df, seeded_key(id_col, seed), rank_col="_r")
    n = df.agg(F.count("*").alias("_n"))
    kept = F.round(F.col("_n") * F.lit(keep_ratio))  # pandas sample(frac) rounds
    sizes = n.select(kept.alias("_k"), F.round(kept * F.lit(train_ratio)).alias("_t"))
    out = join_scalars(ranked, sizes).withColumn(
        split_col,
        F.when(F.col("_r") <= F.col("_t"), "train")
        .when(F.col("_r") <= F.col("_k"), "eval").otherwise("test"))
    return out.drop("_r", "_k", "_t")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """Seeded shuffle then first ``n`` rows: those with the ``n`` smallest
    seeded keys (a top-n, not a sort); ``n = -1`` keeps all, range-sorted."""
    if n < 0:
        return df.withColumn("_key", seeded_key(id_col, seed)).orderBy("_key").drop("_key")
    return (df.withColumn("_key", seeded_key(id_col, seed)).orderBy("_key").limit(n).drop("_key"))


def bootstrap_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` draws with replacement: draw d picks the row of rank
    ``md5(seed:d) mod N + 1`` (first 32 bits; rank by the seeded key). Output keeps a
    ``draw`` column; a row drawn twice appears twice."""
    spark = df.sparkSession
    ranked = global_rank(df, seeded_key(id_col, seed), rank_col="_r")
    N = df.agg(F.count("*").alias("_N"))
    draws = join_scalars(spark.range(n).withColumnRenamed("id", "draw"), N).select(
        "draw", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("_N") + 1).alias("_r"))
    return ranked.join(draws, "_r").drop("_r")


def pick_positions(df: DataFrame, id_col: str, total: int, seed: int = 42) -> DataFrame:
    """``total`` distinct rows chosen at random, never the last row (by id);
    raises when fewer than ``total`` rows are eligible. The rows are written once
    and read for the last id, the count and the ranks."""
    df = materialise(df, "pick-from")
    last = df.agg(F.max(id_col).alias("_last"))
    eligible = join_scalars(df, last).filter(F.col(id_col) != F.col("_last")).drop("_last")
    ranked = global_rank(eligible, seeded_key(id_col, seed), rank_col="_r")
    n = eligible.agg(F.count("*").alias("_ne"))
    chk = n.select(F.when(F.col("_ne") < total, F.raise_error(
        F.lit(f"cannot pick {total} rows: too few eligible rows"))).otherwise(F.lit(True)).alias("_ok"))
    return (join_scalars(ranked.filter(F.col("_r") <= total), chk).filter(F.col("_ok")).drop("_ok")
            .withColumnRenamed("_r", "pick"))
