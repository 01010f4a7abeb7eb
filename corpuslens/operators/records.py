"""Record preparation: joins of a star schema into per-record text, grouped
codes, templating, prompts, annotation flattening, per-author ordering and
sampling. Aggregations are partial (map-side) and no group is collected
whole unless it is a bounded per-record list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_paragraphs
from ..session import join_scalars
from .ranking import global_rank


# ---------------------------------------------------------------------------
# F6, A13, F7, A14


def first_per_key(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """One row per key: the row with the smallest ``order_col`` (``min_by`` is a
    partial aggregate, so a hot key is reduced map-side)."""
    cols = [c for c in df.columns]
    picked = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r"))
    return picked.select("_r.*")


def top_k_values(df: DataFrame, array_col: str, k: int, order_col: str) -> DataFrame:
    """(value, cnt, rank) of the k most frequent array elements; ties keep the
    order of first appearance (by ``order_col``, then place in the array)."""
    seen = df.select(F.col(order_col).alias("_o"), F.posexplode(array_col).alias("_p", "value"))
    counts = seen.groupBy("value").agg(F.count("*").alias("cnt"), F.min(F.struct("_o", "_p")).alias("_first"))
    top = counts.orderBy(F.desc("cnt"), "_first").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), "_first"))).drop("_first")


def keep_top_codes(df: DataFrame, array_col: str, k: int, order_col: str) -> DataFrame:
    """Rows whose codes intersect the k most frequent codes, codes pruned to those."""
    top = top_k_values(df, array_col, k, order_col).agg(F.collect_list("value").alias("_top"))  # k values
    j = join_scalars(df, top)
    return (j.filter(F.arrays_overlap(array_col, "_top"))
            .withColumn(array_col, F.filter(array_col, lambda x: F.array_contains(F.col("_top"), x)))
            .drop("_top"))


def group_records(df: DataFrame, key: str, order_col: str, first_cols: list[str], list_cols: list[str]) -> DataFrame:
    """Group by ``key``: first (by ``order_col``) value of ``first_cols`` and the
    ``list_cols`` values in ``order_col`` order. Lists are per record (bounded
    by the record's own rows)."""
    aggs = [F.min_by(c, order_col).alias(c) for c in first_cols]
    aggs += [F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(c).alias("v")))),
                         lambda s: s["v"]).alias(c) for c in list_cols]
    return df.groupBy(key).agg(*aggs)


# ---------------------------------------------------------------------------
# F8, F9, F10, X6


def control_code(country: Column, year: Column) -> Column:
    return F.concat(F.lit("Countries: "), country, F.lit(", Year: "), year.cast("string"))


def gender_label(g: Column) -> Column:
    return F.when(g == "M", "Male").when(g == "F", "Female").otherwise("Other")


def structured_record(titles: Column, codes: Column, gender: Column, ethnicity: Column) -> Column:
    """``Long_Title: ... ICD9_Code: ... \\nGender: ... Ethnicity: ... \\nText: ``."""
    return F.concat(F.lit("Long_Title: "), F.array_join(titles, ", "), F.lit(" ICD9_Code: "),
                    F.array_join(codes, ", "), F.lit(" \nGender: "), gender_label(gender),
                    F.lit(" Ethnicity: "), ethnicity, F.lit(" \nText: "))


# Prompt presets (prefix, suffix) per dataset kind.
PROMPT_PRESETS = {
    "tab": ("", "\n"),
    "mimic": ("Diagnosis: ", " Summary :"),
    "wiki": ("Generate a biography about: ", " Biography :"),
}


def build_prompt(x: Column, preset: str | None = None, begin: str = "", end: str = "") -> Column:
    if preset is not None:
        begin, end = PROMPT_PRESETS[preset]
    return F.concat(F.lit(begin), x.cast("string"), F.lit(end))


def repeat_rows(df: DataFrame, n: int, seq_col: str = "seq_no") -> DataFrame:
    """Each row ``n`` times with a 0-based ``seq_col``."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(seq_col))


# ---------------------------------------------------------------------------
# Nested annotations


def annotation_mentions(df: DataFrame, ann_col: str = "annotations", id_col: str = "doc_id",
                        types: list[str] | None = None, first_annotator_only: bool = False) -> DataFrame:
    """(doc_id, annotator, pos, entity_type, identifier_type, span_text) from
    ``map<annotator, struct<entity_mentions: array<struct<...>>>>``; all
    annotators (duplicates kept) or only the first one in the record."""
    entries = F.map_entries(ann_col)
    if first_annotator_only:
        entries = F.slice(entries, 1, 1)
    ex = df.select(id_col, F.explode(entries).alias("_e")).select(id_col, F.col("_e.key").alias("annotator"), F.col("_e.value").alias("_a"))
    m = ex.select(id_col, "annotator", F.posexplode("_a.entity_mentions").alias("pos", "_m")).select(
        id_col, "annotator", "pos", "_m.entity_type", "_m.identifier_type", "_m.span_text")
    if types is not None:
        m = m.filter(F.col("entity_type").isin(types))
    return m


def control_code_lines(df: DataFrame, text_col: str = "text", ann_col: str = "annotations",
                       id_col: str = "doc_id", paragraphs: int = 6,
                       identifier_types: tuple[str, ...] = ("DIRECT", "QUASI")) -> DataFrame:
    """Per document: ``TYPE: a, b`` lines (first annotator, identifying spans
    that occur in the first paragraphs), types and spans in mention order."""
    head = first_paragraphs(F.col(text_col), paragraphs)
    first = F.get(F.map_values(ann_col), F.lit(0))["entity_mentions"]
    rows = df.select(id_col, head.alias("_head"), first.alias("_all"))
    own = lambda m: m["identifier_type"].isin(list(identifier_types)) & F.contains(F.col("_head"), m["span_text"])
    rows = rows.select(id_col, F.filter("_all", own).alias("_m")).select(id_col, "_m", F.array_distinct(F.transform("_m", lambda m: m["entity_type"])).alias("_types"))
    spans = lambda t: F.transform(F.filter("_m", lambda m: m["entity_type"] == t), lambda m: m["span_text"])
    lines = F.transform("_types", lambda t: F.concat(t, F.lit(": "), F.array_join(spans(t), ", ")))
    return rows.filter(F.size("_m") > 0).select(id_col, F.array_join(lines, "\n").alias("control_codes"))


# Control-code categories recognised when parsing lines back.
CODE_TYPES = ["CODE", "PERSON", "DATETIME", "LOC", "ORG", "DEM", "QUANTITY", "MISE"]


def parse_control_codes(df: DataFrame, col: str = "control_codes", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, entity) from ``TYPE: a, b`` lines (recognised types only)."""
    pat = r"(?m)^(" + "|".join(CODE_TYPES) + r"):\s*(.*)$"
    vals = df.select(id_col, F.explode(F.regexp_extract_all(F.col(col), F.lit(pat), 2)).alias("_v"))
    return vals.select(id_col, F.explode(F.split("_v", ",")).alias("_e")).select(
        id_col, F.regexp_replace("_e", r"(?U)^\s+|\s+$", "").alias("entity"))


# ---------------------------------------------------------------------------
# authors


def rank_within(df: DataFrame, key: str, order_col: str, *, bucket_width: int = 1 << 16,
                rank_col: str = "position") -> DataFrame:
    """1-based position of each row within its ``key`` by numeric ``order_col``.

    A key holding a large share of rows is split into order buckets
    (``order_col // bucket_width``): per-(key, bucket) counts give bucket
    offsets and each (key, bucket) slice is ranked separately, so no task
    sorts a whole hot key.
    """
    b = df.withColumn("_b", F.floor(F.col(order_col) / bucket_width))
    counts = b.groupBy(key, "_b").agg(F.count("*").alias("_n"))
    offsets = counts.select(key, "_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    ranked = b.join(offsets, [key, "_b"]).withColumn(
        rank_col, F.col("_off") + F.row_number().over(Window.partitionBy(key, "_b").orderBy(order_col)))
    return ranked.drop("_b", "_off")


def author_mapping(df: DataFrame, author: str, id_col: str) -> DataFrame:
    """(author, id, position, n_records): the records of each author in id order,
    as a long table (an author's list is never built in one row)."""
    pos = rank_within(df.select(author, id_col), author, id_col)
    n = df.groupBy(author).agg(F.count("*").alias("n_records"))
    return pos.join(n, author)


def round_robin(df: DataFrame, author: str, id_col: str, draws: DataFrame) -> DataFrame:
    """For draws (author, k): the author's record at position (k mod n) + 1."""
    m = author_mapping(df, author, id_col)
    d = draws.join(m.select(author, "n_records").distinct(), author) \
        .withColumn("position", F.pmod(F.col("k"), F.col("n_records")) + 1)
    return d.join(m.select(author, "position", id_col), [author, "position"]).drop("n_records")


def poisson_author_sample(df: DataFrame, author: str, id_col: str, *, q: float, rounds: int,
                          seed: int = 0) -> DataFrame:
    """Each round draws every author independently with probability ``q``
    (md5-uniform) and takes that author's next record round-robin (the first
    draw of an author takes its first record): (round, author, id)."""
    authors = df.select(author).distinct()
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(author).cast("string"),
                                             F.col("round").cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    drawn = (authors.select(author, F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
             .filter(u < q).withColumn("k", F.row_number().over(Window.partitionBy(author).orderBy("round")) - 1))
    return round_robin(df, author, id_col, drawn).select("round", author, id_col)


def shuffled_author_batches(df: DataFrame, author: str, id_col: str, *, batch_size: int, epochs: int = 1,
                            seed: int = 0) -> DataFrame:
    """Each epoch cuts the authors in md5(seed:epoch:author) order into batches (the last
    short one is dropped; a null author has no place) and takes each drawn author's next
    record round-robin: (epoch, batch, author, id)."""
    authors = df.select(author).filter(F.col(author).isNotNull()).distinct()
    n = authors.agg(F.count("*").alias("_n_authors"))
    drawn = None
    for e in range(epochs):
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(e)), F.col(author).cast("string")))
        ranked = global_rank(authors, key).select(author, F.lit(e).alias("epoch"), F.floor((F.col("rank") - 1) / batch_size).alias("batch"))
        drawn = ranked if drawn is None else drawn.unionByName(ranked)
    drawn = (join_scalars(drawn, n).filter((F.col("batch") + 1) * batch_size <= F.col("_n_authors")).drop("_n_authors")
             .withColumn("k", F.row_number().over(Window.partitionBy(author).orderBy("epoch")) - 1))
    return round_robin(df, author, id_col, drawn).select("epoch", "batch", author, id_col)


def sampler_schedule(n_authors: Column, batch_size: int, epochs: int) -> tuple[Column, Column]:
    """(q, steps): q = batch / #authors, steps = int(epochs * (1/q + 1))."""
    q = F.lit(batch_size) / n_authors
    return q, (F.lit(epochs) * (1 / q + 1)).cast("int")


# ---------------------------------------------------------------------------
# causal-LM packing of prompt/target token ids


def pack_prompt_target(ctx: Column, target: Column, seq_len: int, pad_id: int = 0,
                       single_token: bool = False) -> tuple[Column, Column, Column]:
    """(input_ids, labels, attention_mask) arrays: ids = ctx + target, labels =
    -100 for context positions; left-padded to ``seq_len`` then cut on the right."""
    if single_token:
        target = F.slice(target, -1, 1)
    ids = F.concat(ctx, target)
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(ctx)), target)
    pad = F.greatest(F.lit(seq_len) - F.size(ids), F.lit(0))
    pid = F.slice(F.concat(F.array_repeat(F.lit(pad_id), pad), ids), 1, seq_len)
    plab = F.slice(F.concat(F.array_repeat(F.lit(-100), pad), labels), 1, seq_len)
    mask = F.slice(F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), F.size(ids))), 1, seq_len)
    return pid, plab, mask
