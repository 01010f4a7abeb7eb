import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslens.operators import ranking as R
from corpuslens.operators import records as RC


def test_global_rank_equals_row_number(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    key = R.seeded_key("k", 7)
    a = {r.k: r["rank"] for r in R.global_rank(df, key, prefix=2).collect()}
    b = {r.k: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy(key))).collect()}
    assert a == b


@pytest.mark.parametrize("n", [1, 9, 10, 11, 1000])
def test_exact_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    out = R.exact_split(df, "doc_id").groupBy("split").count().collect()
    sizes = {r.split: r["count"] for r in out}
    import math
    held = math.ceil(n * 0.2)
    test = math.ceil(held * 0.5)
    assert sizes.get("test", 0) == test and sizes.get("validation", 0) == held - test
    assert sum(sizes.values()) == n


def test_pick_positions_never_last_and_raises(spark):
    df = spark.range(10).withColumnRenamed("id", "doc_id")
    picks = [r.doc_id for r in R.pick_positions(df, "doc_id", 9).collect()]
    assert len(set(picks)) == 9 and 9 not in picks
    with pytest.raises(Exception):
        R.pick_positions(df, "doc_id", 10).collect()


def test_rank_within_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("a"),
                                  F.col("id").alias("i"))
    got = {(r.a, r.i): r.position for r in RC.rank_within(df, "a", "i", bucket_width=64).collect()}
    exp = {(r.a, r.i): r.rn for r in df.withColumn(
        "rn", F.row_number().over(Window.partitionBy("a").orderBy("i"))).collect()}
    assert got == exp


def test_bootstrap_size(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    assert R.bootstrap_sample(df, "doc_id", 200).count() == 200
