"""Descriptive corpus statistics: entities, n-grams, lengths.

"First appearance" (the tie-break of the reference's insertion-ordered
counters) is the pair (doc_id, position within the document).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ngrams, word_punct_tokens, ws_tokens
from ..session import join_scalars

# Default rule-based entity recogniser (ASCII classes so any
# regex engine finds the same spans). Order matters: earlier rules win.
ENTITY_RULES = [
    ("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("IP", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    ("PHONE", r"\+[0-9]{1,3}(?:[ -][0-9]{2,4}){2,4}"),
    ("DATE", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
    ("NUMBER", r"[0-9]{6,}"),
    ("PROPER", r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"),
]


def rules_pattern(rules=ENTITY_RULES) -> str:
    return "|".join(f"(?:{p})" for _, p in rules)


def extract_entities(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id",
                     rules=ENTITY_RULES, model=None) -> DataFrame:
    """Mentions (doc_id, pos, entity, label); pos = match ordinal in the doc.

    Map-only (no shuffle). With ``model``, a function from one text to
    ``(entity, label)`` pairs in order, that recogniser replaces the rules; it
    runs in Arrow batches and is pickled to the workers.
    """
    if model is not None:
        def recognise(it):
            for pdf in it:
                found = [(i, k, e, lab) for i, t in zip(pdf["doc_id"], pdf["text"]) if t is not None for k, (e, lab) in enumerate(model(t))]
                yield pd.DataFrame(found, columns=["doc_id", "pos", "entity", "label"])

        d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        return d.mapInPandas(recognise, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, pos int, entity string, label string")
    m = docs.select(F.col(id_col).alias("doc_id"),
                    F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(rules_pattern(rules)), 0))
                    .alias("pos", "entity"))
    label = F.lit(None).cast("string")
    for name, pat in reversed(rules):
        label = F.when(F.col("entity").rlike(f"^(?:{pat})$"), F.lit(name)).otherwise(label)
    return m.withColumn("label", label)


def entity_counts(mentions: DataFrame) -> DataFrame:
    """(entity, cnt, first_doc, first_pos): every mention counts, exact case."""
    return (mentions.groupBy("entity")
            .agg(F.count("*").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("_f"))
            .select("entity", "cnt", F.col("_f.doc_id").alias("first_doc"),
                    F.col("_f.pos").alias("first_pos")))


def top_entities(counts: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent, ties by first appearance (top-n, no global sort)."""
    top = counts.orderBy(F.desc("cnt"), "first_doc", "first_pos").limit(n)
    return _ranked(top, [F.desc("cnt"), F.col("first_doc"), F.col("first_pos")])


def least_entities(counts: DataFrame, n: int = 10, truncate: bool = True) -> DataFrame:
    """Every entity whose count is <= the n-th smallest count (all ties kept);
    with ``truncate`` only the first ``n`` of those in first-seen order."""
    thr = counts.orderBy("cnt").limit(n).agg(F.max("cnt").alias("_thr"))
    least = join_scalars(counts, thr).filter(F.col("cnt") <= F.col("_thr")).drop("_thr")
    if truncate:
        least = least.orderBy("first_doc", "first_pos").limit(n)
    return _ranked(least, [F.col("first_doc"), F.col("first_pos")])


def entity_report(counts: DataFrame, max_threshold: int = 10, min_threshold: int = 10) -> DataFrame:
    """(kind, rank, entity, cnt) for the most and least frequent entities."""
    most = top_entities(counts, max_threshold).withColumn("kind", F.lit("most"))
    least = least_entities(counts, min_threshold).withColumn("kind", F.lit("least"))
    cols = ["kind", "rank", "entity", "cnt"]
    return most.select(*cols).unionByName(least.select(*cols))


def _ranked(df: DataFrame, order) -> DataFrame:
    # df holds at most n rows here (after a top-n limit): a single-partition
    # window over it is bounded.
    from pyspark.sql import Window
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: Tokens that are counted at a time in a task.
GRAM_CHUNK = 4_000_000


def _chunk_grams(batches: list[pa.RecordBatch], n: int) -> pa.RecordBatch | None:
    """(ngram, cnt, doc_id, pos) of the documents of some batches: tokens as
    numbers, equal n-grams grouped by number, each spelled out once."""
    docs = pa.Table.from_batches(batches).combine_chunks()
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")], null_placement="at_start")).combine_chunks()
    lists, ids = docs["_t"].combine_chunks(), docs["doc_id"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    if not (size >= n).any():
        return None
    runs = pc.run_end_encode(ids)  # rows of one id are one document
    doc = np.searchsorted(runs.run_ends.to_numpy(), np.arange(len(size)), side="right")
    words = lists.flatten().dictionary_encode(null_encoding="encode")
    start = np.cumsum(size) - size
    pos = np.arange(size.sum()) - np.repeat(start, size)
    at = np.flatnonzero(pos <= np.repeat(size, size) - n)
    word = words.indices.to_numpy().astype(np.int64)
    gram, base = word[at], len(words.dictionary)
    for k in range(1, n):
        if k > 1:
            gram = np.unique(gram, return_inverse=True)[1]
        gram = gram * base + word[at + k]
    bits = len(gram).bit_length()
    if int(gram.max()) >> (62 - bits):
        gram = np.unique(gram, return_inverse=True)[1]
    both = np.sort(gram << bits | np.arange(len(gram)))  # one sort of (n-gram, place)
    gram, at = both >> bits, at[both & ((1 << bits) - 1)]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    seen = np.minimum.reduceat((np.repeat(doc, size)[at] << 32) + pos[at], first)
    parts = [words.dictionary.take(pa.array(word[at[first] + k])) for k in range(n)]
    text = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", parts[0].type), null_handling="skip")
    count = np.diff(np.append(first, len(gram)))
    return pa.RecordBatch.from_arrays([text, pa.array(count), runs.values.take(pa.array(seen >> 32)), pa.array((seen & 0xFFFFFFFF).astype(np.int32))],
                                      names=["ngram", "cnt", "doc_id", "pos"])


def _gram_rows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None:
                held.append(b)
                tokens += len(b["_t"].values)
            if held and (b is None or tokens >= GRAM_CHUNK):
                out = _chunk_grams(held, n)
                held, tokens = [], 0
                for k in range(0, 0 if out is None else len(out), 1 << 16):
                    yield out.slice(k, 1 << 16)
    return rows


def ngram_counts(docs: DataFrame, n: int = 2, *, text_col: str = "text", id_col: str = "doc_id",
                 tokens=None) -> DataFrame:
    """(ngram, cnt, first_doc, first_pos); n-grams never cross documents.

    Tokens default to lower-cased word/punctuation tokens; pass ``tokens`` (a
    Column of string arrays) to use another tokeniser. A task counts the n-grams
    of some millions of tokens by number before they are grouped as texts.
    """
    tok = tokens if tokens is not None else word_punct_tokens(F.col(text_col))
    t = docs.select(F.col(id_col).alias("doc_id"), tok.alias("_t"))
    kind = t.schema["doc_id"].dataType
    if isinstance(kind, (T.IntegralType, T.DateType)) or kind == T.StringType():
        g = t.mapInArrow(_gram_rows(n), f"ngram string, cnt long, doc_id {kind.simpleString()}, pos int")
    else:  # other ids are ordered by Spark
        g = t.select("doc_id", F.posexplode(ngrams(F.col("_t"), n)).alias("pos", "ngram")).withColumn("cnt", F.lit(1).cast("long"))
    return (g.groupBy("ngram")
            .agg(F.sum("cnt").alias("cnt"), F.min(F.struct("doc_id", "pos")).alias("_f"))
            .select("ngram", "cnt", F.col("_f.doc_id").alias("first_doc"),
                    F.col("_f.pos").alias("first_pos")))


def ngram_extremes(counts: DataFrame, top_k: int = 5) -> DataFrame:
    """(kind, rank, ngram, cnt): most common (desc count, first seen first) and
    least common (asc count, last seen first)."""
    most = _ranked(counts.orderBy(F.desc("cnt"), "first_doc", "first_pos").limit(top_k),
                   [F.desc("cnt"), F.col("first_doc"), F.col("first_pos")]).withColumn("kind", F.lit("most"))
    least = _ranked(counts.orderBy("cnt", F.desc("first_doc"), F.desc("first_pos")).limit(top_k),
                    [F.col("cnt"), F.desc("first_doc"), F.desc("first_pos")]).withColumn("kind", F.lit("least"))
    cols = ["kind", "rank", "ngram", "cnt"]
    return most.select(*cols).unionByName(least.select(*cols))


def length_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: avg/min/max whitespace length and avg distinct words per document."""
    w = ws_tokens(F.col(text_col))
    return docs.select(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("u")).agg(
        F.avg("n").alias("avg_len"), F.min("n").cast("double").alias("min_len"),
        F.max("n").cast("double").alias("max_len"), F.avg("u").alias("avg_unique"))


def length_comparison(syn: DataFrame, ref: DataFrame, text_col: str = "text") -> DataFrame:
    """(metric, syn, ref, diff) for the four length metrics (two scans, one row each)."""
    metrics = ["avg_len", "min_len", "max_len", "avg_unique"]
    s = length_stats(syn, text_col).select([F.col(m).alias("s_" + m) for m in metrics])
    r = length_stats(ref, text_col).select([F.col(m).alias("r_" + m) for m in metrics])
    both = join_scalars(s, r)
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col("s_" + m).alias("syn"),
                              F.col("r_" + m).alias("ref")) for m in metrics])
    return (both.select(F.inline(rows))
            .withColumn("diff", F.col("syn") - F.col("ref")))
