"""Latent Dirichlet allocation by variational EM on tables.

The word side (one row a term, one weight a topic) and the document side (one
row a document) are distributed tables, so neither the vocabulary nor the
corpus passes through the driver. The counts are packed once into blocks of
whole documents, which stay where they are; a pass sends each block the weights
of its own terms, re-estimates its documents' mixtures from them, then sums its
share of the words' topics from the mixtures. What moves in a pass is one row a
block and distinct term, there and back, and one row a document; both sides are
written in one small table.

Starting weights come from md5(seed:term:topic), so a fit can be repeated.
Documents without a term take no part; rows of one id are one document; null
texts hold no term; an empty corpus has no topics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import join_scalars, materialise
from .models import topic_tokens


@dataclass
class Topics:
    words: DataFrame      # term, l0..: Dirichlet weights of the topics
    mixtures: DataFrame   # doc_id, g0..
    counts: DataFrame     # doc_id, term, tf
    k: int


#: Counts of a block, at most so many on average and, as long as cores lack blocks, no fewer than the least.
BLOCK_COUNTS, LEAST_COUNTS = 4_000_000, 50_000
#: Counts of a block that are multiplied at a time.
SLICE = 500_000


def digamma(x, log=F.log):
    """Six steps of the recurrence, then the asymptotic series (error below 1e-8 for
    x > 0), of a column or, with numpy's ``log``, an array."""
    y = x + 6
    shift = sum((1.0 / (x + i) for i in range(1, 6)), 1.0 / x)
    inverse = 1.0 / (y * y)
    return log(y) - 0.5 / y - inverse * (1 / 12 - inverse * (1 / 120 - inverse * (1 / 252))) - shift


def topic_counts(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf)."""
    terms = docs.select(F.col(id_col).alias("doc_id"), F.explode(topic_tokens(F.col(text_col))).alias("term"))
    return terms.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def _start_weight(seed: int, topic: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("term"), F.lit(f":{topic}")))
    return 1 + F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _pack(rows: pa.Table) -> pa.Table:
    """One row: the block's documents with their sizes, its terms' numbers, and
    its counts as (place of the document, place of the term, tf)."""
    docs = rows["doc_id"].combine_chunks().dictionary_encode()
    doc, tf = docs.indices.to_numpy(), rows["tf"].to_numpy()
    terms, word = np.unique(rows["id"].to_numpy(), return_inverse=True)
    sizes = np.bincount(doc, tf, len(docs.dictionary)).astype(np.int64)
    packed = [a.tobytes() for a in (terms, doc.astype(np.int32), word.astype(np.int32), tf.astype(np.int64))]
    lists = [pa.ListArray.from_arrays([0, len(docs.dictionary)], v) for v in (docs.dictionary, pa.array(sizes))]
    return pa.table([rows["block"].slice(0, 1), *lists, *[pa.array([p], pa.binary()) for p in packed]], names=["block", "docs", "sizes", "terms", "doc", "word", "tf"])


def _block_pass(k: int, alpha: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's part of a pass: (block, key, v0..) with its documents' sums and,
    as block -1, its terms' sums."""
    def sums(block: tuple, theta: np.ndarray, beta: np.ndarray, by: np.ndarray, n: int) -> np.ndarray:
        doc, word, tf = block
        out = np.zeros((n, k))
        for s in (slice(i, i + SLICE) for i in range(0, len(doc), SLICE)):
            p = theta[doc[s]] * beta[word[s]]
            with np.errstate(divide="raise", invalid="raise"):
                p *= (tf[s] / p.sum(axis=1))[:, None]
            for t in range(k):
                out[:, t] += np.bincount(by[s], p[:, t], n)
        return out

    def mixture(g: np.ndarray) -> np.ndarray:
        return np.exp(digamma(g, np.log) - digamma(g.sum(axis=1), np.log)[:, None])

    def step(packed: pa.Table, sides: pa.Table) -> pa.Table:
        row = packed.to_batches()[0]
        terms, doc, word, tf = (np.frombuffer(row[c][0].as_buffer(), t) for c, t in (("terms", np.int64), ("doc", np.int32), ("word", np.int32), ("tf", np.int64)))
        weights = []
        for own in (pc.equal(sides["of_doc"], True), pc.equal(sides["of_doc"], False)):
            side = sides.filter(own).sort_by("key")
            weights.append(np.column_stack([side[f"v{t}"].to_numpy() for t in range(k)]))
        gamma, beta = weights
        block = (doc, word, tf)
        mixed = sums(block, mixture(gamma), beta, doc, len(gamma))
        topics = sums(block, mixture(alpha + mixed), beta, word, len(terms))
        at = np.concatenate((np.full(len(gamma), row["block"][0].as_py(), np.int32), np.full(len(terms), -1, np.int32)))
        keys, values = np.concatenate((np.arange(len(gamma)), terms)), np.concatenate((mixed, topics))
        return pa.table([pa.array(at), pa.array(keys), *[pa.array(values[:, t]) for t in range(k)]], names=["block", "key", *[f"v{t}" for t in range(k)]])
    return step


def _blocks(counts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The packed blocks, the terms (term, id, blocks they are in), and the number of blocks."""
    n, cores = counts.count(), counts.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n // BLOCK_COUNTS), min(2 * cores, n // LEAST_COUNTS))
    placed = counts.withColumn("block", F.when(F.col("doc_id").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)).cast("int")))
    terms = placed.select("term", "block").distinct().groupBy("term").agg(F.collect_list("block").alias("blocks"))
    terms = materialise(terms.withColumn("id", F.monotonically_increasing_id()), "topic-terms")
    rows = placed.filter("block is not null").join(terms.select("term", "id"), "term").select("block", "doc_id", "id", "tf")
    kind = counts.schema["doc_id"].dataType.simpleString()
    packed = rows.groupBy("block").applyInArrow(_pack, f"block int, docs array<{kind}>, sizes array<long>, terms binary, doc binary, word binary, tf binary")
    return materialise(packed, "topic-blocks"), terms, n_blocks


def fit_topics(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", k: int = 3, passes: int = 10,
               alpha: float | None = None, eta: float | None = None, seed: int = 7) -> Topics:
    """Topics of the corpus; ``alpha`` and ``eta`` default to 1 / k."""
    if k < 1 or passes < 0:
        raise ValueError("k must be at least 1 and passes at least 0")
    alpha, eta = 1 / k if alpha is None else alpha, 1 / k if eta is None else eta
    counts = materialise(topic_counts(docs, text_col=text_col, id_col=id_col), "topic-counts")
    if not passes:
        words = counts.select("term").distinct().select("term", *[_start_weight(seed, t).alias(f"l{t}") for t in range(k)])
        mixtures = counts.groupBy("doc_id").agg(*[(alpha + F.sum("tf") / k).alias(f"g{t}") for t in range(k)])
        return Topics(materialise(words, "topic-words"), materialise(mixtures, "topic-mixtures"), counts, k)
    packed, terms, n_blocks = _blocks(counts)
    places = packed.select("block", F.posexplode(F.arrays_zip("docs", "sizes")).alias("key", "d")).select("block", F.col("key").cast("long").alias("key"), F.col("d.docs").alias("doc_id"), F.col("d.sizes").alias("n"))
    vs = [f"v{t}" for t in range(k)]
    start = terms.select(F.lit(-1).alias("block"), F.col("id").alias("key"), *[_start_weight(seed, t).alias(v) for t, v in enumerate(vs)])
    state = materialise(start.unionByName(places.select("block", "key", *[(alpha + F.col("n") / k).alias(v) for v in vs])), "topic-state")
    held = packed.select("block", "terms", "doc", "word", "tf").repartition(n_blocks, "block").persist(StorageLevel.DISK_ONLY)
    schema = "block int, key long, " + ", ".join(f"{v} double" for v in vs)
    for _ in range(passes):
        words = state.filter("block < 0")
        beta = join_scalars(words, words.agg(*[F.sum(v).alias(f"s{v}") for v in vs])) \
            .select("key", *[F.exp(digamma(F.col(v)) - digamma(F.col(f"s{v}"))).alias(v) for v in vs])
        sent = beta.join(terms.select(F.col("id").alias("key"), "blocks"), "key").select(F.explode("blocks").alias("block"), "key", F.lit(False).alias("of_doc"), *vs)
        sides = sent.unionByName(state.filter("block >= 0").select("block", "key", F.lit(True).alias("of_doc"), *vs))
        summed = held.groupBy("block").cogroup(sides.groupBy("block")).applyInArrow(_block_pass(k, alpha), schema).groupBy("block", "key")
        prior = F.when(F.col("block") < 0, F.lit(eta)).otherwise(F.lit(alpha))
        state = materialise(summed.agg(*[F.sum(v).alias(v) for v in vs]).select("block", "key", *[(prior + F.col(v)).alias(v) for v in vs]), "topic-state")
    held.unpersist()
    words = state.filter("block < 0").join(terms.select(F.col("id").alias("key"), "term"), "key").select("term", *[F.col(v).alias(f"l{t}") for t, v in enumerate(vs)])
    mixtures = state.filter("block >= 0").join(places, ["block", "key"]).select("doc_id", *[F.col(v).alias(f"g{t}") for t, v in enumerate(vs)])
    return Topics(materialise(words, "topic-words"), materialise(mixtures, "topic-mixtures"), counts, k)


def term_probabilities(topics: Topics) -> DataFrame:
    """(topic, term, p_term_topic): each topic's distribution over the terms."""
    totals = topics.words.agg(*[F.sum(f"l{t}").alias(f"s{t}") for t in range(topics.k)])
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), (F.col(f"l{t}") / F.col(f"s{t}")).alias("p_term_topic")) for t in range(topics.k)])
    return join_scalars(topics.words, totals).select("term", F.explode(rows).alias("r")).select("r.topic", "term", "r.p_term_topic")


def top_terms(topics: Topics, n: int = 5) -> DataFrame:
    """(topic, rank, term, weight): the n likeliest terms of each topic, ties by
    term; chosen in hash parts of a topic first."""
    rows = term_probabilities(topics).withColumnRenamed("p_term_topic", "weight")
    order = [F.desc("weight"), F.col("term")]
    part = Window.partitionBy("topic", F.pmod(F.xxhash64("term"), F.lit(64))).orderBy(*order)
    few = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= n)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(*order))).filter(F.col("rank") <= n) \
        .select("topic", "rank", "term", "weight")


def topic_shares(topics: Topics) -> DataFrame:
    """(doc_id, topic, p): each document's mixture."""
    whole = sum((F.col(f"g{t}") for t in range(1, topics.k)), F.col("g0"))
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), (F.col(f"g{t}") / whole).alias("p")) for t in range(topics.k)])
    return topics.mixtures.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.topic", "r.p")


def topic_explorer(topics: Topics, *, lam: float = 0.6, top_n: int = 30) -> DataFrame:
    """(topic, term, p_term_topic, p_term, relevance, topic_share) of each topic's
    likeliest terms: relevance = lam ln p(w|t) + (1 - lam) ln(p(w|t) / p(w))."""
    share = topic_shares(topics).groupBy("topic").agg(F.avg("p").alias("topic_share"))
    freq = topics.counts.groupBy("term").agg(F.sum("tf").alias("tf"))
    p_term = join_scalars(freq, freq.agg(F.sum("tf").alias("n"))).select("term", (F.col("tf") / F.col("n")).alias("p_term"))
    top = top_terms(topics, top_n).select("topic", "term", F.col("weight").alias("p_term_topic"))
    relevance = lam * F.log("p_term_topic") + (1 - lam) * F.log(F.col("p_term_topic") / F.col("p_term"))
    return top.join(p_term, "term").join(share, "topic").select("topic", "term", "p_term_topic", "p_term", relevance.alias("relevance"), "topic_share")
