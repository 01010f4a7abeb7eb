"""Source mixing by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1], given as
straight lines between knots. The integral of a schedule is the source's weight
in the mix. Targets share a given multiple of all words by weight; a target
stops at ``cap`` times its source's size and the excess is shared again by
weight until none is above.

A source's documents stand in a fixed random order (md5 of the id). The mix
walks that order, up to ``cap`` times, until the source's target is used up, so
a piece of a document covers an interval of the source's cumulative token
demand. The middle of the interval, inverted through the schedule's cumulative
integral, is the piece's training position; documents are range-sorted by it.

Scale: only narrow rows (id, source, size, md5) are shuffled. Prefix sums are
split: (source, md5 prefix) sums first, offsets over those, then running sums
inside one prefix, so a source with a third of all rows is spread over as many
tasks as its rows need. Sources are never collected; the resharing needs one
one-row aggregate per round.

Defined results: a null text has size 0 (never taken, no position); the null
source is the last one; repeated rows are separate documents; null ids sort
first in their source; equal rows are interchangeable; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import materialise

Schedule = Sequence[tuple[float, float]]
#: Falling, flat and rising schedules, with integrals 3, 1 and 2.
SCHEDULES: tuple[Schedule, ...] = (((0.0, 4.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 3.0)))


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def inverse(schedule: Schedule, share: Column) -> Column:
    """The time by which the schedule has used the given share of its integral."""
    area, before, out = integral(schedule), 0.0, F.lit(schedule[0][0])
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        here = (t1 - t0) * (w0 + w1) / 2
        slope, rest = (w1 - w0) / (t1 - t0), F.greatest(share * area - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        step = F.when(root + w0 > 0, 2 * rest / (root + w0)).otherwise(0.0)
        if here:  # the last line that begins by this share holds it
            out = F.when(share * area >= before, F.least(t0 + step, F.lit(t1))).otherwise(out)
        before += here
    return out


def targets(sizes: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``(source, source_size, schedule, target)`` from ``(source, source_size)``.

    Sources take the schedules in turn, by code point, null last.
    """
    kinds = sizes.schema["source"]
    ranked = (sizes.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()
              .map(lambda r: (r[0][0], r[0][1], r[1] % len(schedules)))
              .toDF(T.StructType([kinds, T.StructField("source_size", T.LongType()), T.StructField("schedule", T.LongType())])))
    weight = F.element_at(F.array(*[F.lit(float(integral(s))) for s in schedules]), (F.col("schedule") + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", weight), "sources")
    most = cap * F.col("source_size")
    rate = 0.0
    while True:  # rate: words for a weight of 1; it only grows, so this ends
        over = F.lit(rate) * F.col("weight") > most
        total, held, free = ranked.agg(F.sum("source_size"), F.sum(F.when(over, most).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        new = (share * total - held) / free if free else rate
        if new <= rate:
            break
        rate = new
    over = F.lit(rate) * F.col("weight") > most
    return ranked.select("source", "source_size", "schedule", F.when(over, most).otherwise(F.lit(rate) * F.col("weight")).alias("target"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES, share: float = 1.5, cap: float = 2.0,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rows_per_bucket: int = 20_000) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken and its
    passes ``[(position, words)]``, sorted by the first position (untaken last).

    ``cap`` must be a whole number: it is also the number of passes.
    """
    c = lambda n: F.col(f"`{n}`")
    sized = materialise(docs.select(c(id_col).alias("id"), c(source_col).alias("source"), words(c(text_col)).alias("size"),
                                    F.md5(F.coalesce(c(id_col).cast("string"), F.lit("")).cast("binary")).alias("key")), "sizes")
    n, digits = sized.count(), 0
    while 16 ** digits * rows_per_bucket < n:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = materialise(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "bucket-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), schedules, share, cap)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).alias("o")
    offsets = offsets.join(goal.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select("o.source", "o.bucket", "o.offset", "g.source_size", "g.schedule", "g.target")
    running = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("running", F.sum("size").over(running)).alias("d")
    rows = (placed.join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.bucket") == F.col("o.bucket")))
            .select("d.id", "d.source", "d.size", "o.source_size", "o.target", "o.schedule",
                    (F.col("o.offset") + F.col("d.running") - F.col("d.size")).alias("start")))
    goal_words = F.round("target").cast("long")
    passes = []
    for k in range(int(cap)):
        start = F.col("start") + k * F.col("source_size")
        took = F.greatest(F.least(goal_words - start, F.col("size")), F.lit(0)).cast("long")
        share_used = (start + took / 2) / F.greatest(F.col("target"), F.lit(1.0))
        at = F.coalesce(*[F.when(F.col("schedule") == i, inverse(s, share_used)) for i, s in enumerate(schedules)])
        passes.append(F.struct(at.alias("position"), took.alias("words")))
    out = rows.withColumn("passes", F.filter(F.array(*passes), lambda p: p["words"] > 0))
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return (out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken.alias("taken"), "passes")
            .orderBy(F.get("passes", F.lit(0))["position"].asc_nulls_last(), id_col))  # the id spreads the untaken


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per pass of a taken document, range-sorted by training position."""
    keep = [c for c in mixed.columns if c != "passes"]
    return mixed.select(*keep, F.explode("passes").alias("p")).select(*keep, "p.position", "p.words").orderBy("position")
