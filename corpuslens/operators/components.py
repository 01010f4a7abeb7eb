"""Connected components of many small graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def component_roots(edges: DataFrame, key: str, max_rounds: int = 64) -> DataFrame:
    """``(key, node, root)`` for undirected edges ``(key, u, v)``; nodes of
    different keys are different, root is the component's smallest node.

    Rounds of two steps, each a grouped minimum and a join: first every node ties
    its greater neighbours to the least node it knows, then its smaller ones; the
    forest of ties gets flat in about log n rounds. A round is written to the
    shared scratch folder; ``max_rounds`` without rest raises.
    """
    forest = materialise(edges.filter("u <> v").select(key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "ties")
    before = None
    for _ in range(max_rounds):
        ways = forest.unionByName(forest.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy(key, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        upward = ways.filter("v > u").join(least, [key, "u"]).select(key, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = upward.groupBy(key, "u").agg(F.min("v").alias("m"))
        tied = upward.join(least, [key, "u"]).filter("v <> m").select(key, F.col("v").alias("u"), F.col("m").alias("v"))
        forest = materialise(tied.unionByName(least.select(key, "u", F.col("m").alias("v"))).distinct(), "ties")
        now = forest.agg(F.count("*"), F.sum(F.xxhash64(key, "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return forest.select(key, F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(forest.select(key, F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not come to rest in {max_rounds} rounds")
