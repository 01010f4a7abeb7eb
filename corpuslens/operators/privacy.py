"""Privacy audits: entity leakage and entity-phrase (span) memorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import join_scalars, materialise
from .search import context_phrases, entity_mentions, phrases_found_in


def leakage_detail(docs: DataFrame, entities: DataFrame, *, text_col: str = "text",
                   id_col: str = "doc_id") -> DataFrame:
    """Per document: number of entity entries found and the distinct entities found.

    Documents without any hit are kept with 0 (left join from all documents).
    """
    hits = entity_mentions(docs, entities, text_col=text_col, id_col=id_col)
    per_doc = hits.groupBy("doc_id").agg(
        F.count("*").alias("n_leaked"),
        F.array_join(F.array_sort(F.collect_set("entity")), "|").alias("leaked_entities"))
    base = docs.select(F.col(id_col).alias("doc_id"))
    return (base.join(per_doc, "doc_id", "left")
            .select("doc_id", F.coalesce("n_leaked", F.lit(0)).cast("bigint").alias("n_leaked"),
                    F.coalesce("leaked_entities", F.lit("")).alias("leaked_entities")))


def entity_leakage(docs: DataFrame, entities: DataFrame, *, text_col: str = "text",
                   id_col: str = "doc_id") -> DataFrame:
    """One row: documents, total entity entries leaked, average per document.

    ``avg_leaked_per_doc`` is entities per paragraph (not a percentage).
    ``share_entities_leaked`` = distinct leaked entities / distinct listed entities.
    """
    hits = entity_mentions(docs, entities, text_col=text_col, id_col=id_col)
    h = hits.agg(F.count("*").alias("n_leaked"),
                 F.count_distinct("entity").alias("n_distinct_leaked"))
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    n_ent = entities.select(F.regexp_replace("entity", '^"+|"+$', "").alias("e")) \
        .agg(F.count_distinct("e").alias("n_entities"))
    return (join_scalars(n_docs, h, n_ent)
            .select("n_docs", "n_leaked",
                    F.try_divide("n_leaked", "n_docs").alias("avg_leaked_per_doc"),
                    F.try_divide("n_distinct_leaked", "n_entities").alias("share_entities_leaked")))


def leakage_report(docs: DataFrame, entities: DataFrame, *, text_col: str = "text",
                   id_col: str = "doc_id") -> DataFrame:
    """Report over *distinct* document texts (duplicate texts count once).

    avg_leaked_per_doc: entity entries found per distinct text;
    avg_unique_leaked_per_doc: distinct entities per distinct text;
    n_unique_leaked: distinct entities found anywhere.

    Identical texts have identical hits, so every document is searched where
    it lies and one representative (smallest id) per SHA-256 of the text is
    kept: only (digest, id) pairs are shuffled, never the texts.
    """
    d = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"),
                                                         F.col(text_col).alias("text"))
    reps = d.groupBy(F.sha2("text", 256).alias("_digest")).agg(F.min("doc_id").alias("doc_id"))
    hits = entity_mentions(d, entities, text_col="text", id_col="doc_id") \
        .join(reps.select("doc_id"), "doc_id", "left_semi")
    per_text = hits.groupBy("doc_id").agg(F.count("*").alias("n"),
                                          F.count_distinct("entity").alias("u"))
    tot = per_text.agg(F.sum("n").alias("n"), F.sum("u").alias("u"))
    uniq = hits.agg(F.count_distinct("entity").alias("n_unique_leaked"))
    n_texts = reps.agg(F.count("*").alias("n_texts"))
    return (join_scalars(n_texts, tot, uniq)
            .select("n_texts",
                    F.try_divide(F.coalesce("n", F.lit(0)), F.col("n_texts")).alias("avg_leaked_per_doc"),
                    F.try_divide(F.coalesce("u", F.lit(0)), F.col("n_texts")).alias("avg_unique_leaked_per_doc"),
                    "n_unique_leaked"))


def span_memorisation(syn: DataFrame, ref: DataFrame, entities: DataFrame, *, window: int = 3,
                      remove_duplicates: bool = True, text_col: str = "text",
                      id_col: str = "doc_id") -> DataFrame:
    """Entity-phrase overlap: phrases around entities in ``syn`` that occur verbatim
    in some ``ref`` text, counted per context length. Returns (context_len, count)."""
    phrases = context_phrases(syn, entities, window=window, text_col=text_col, id_col=id_col) \
        .select("entity", "phrase", "context_len")
    if remove_duplicates:
        phrases = phrases.dropDuplicates(["entity", "phrase", "context_len"])
    phrases = materialise(phrases, "phrases")  # read by the search and by the final count
    found = phrases_found_in(phrases.select("phrase"), ref, text_col=text_col, id_col=id_col)
    return (phrases.join(found, "phrase", "left_semi")
            .groupBy("context_len").agg(F.count("*").alias("count")))


def span_overlap_ratio(syn: DataFrame, ref: DataFrame, entities: DataFrame, *, window: int = 3,
                       remove_duplicates: bool = True, text_col: str = "text",
                       id_col: str = "doc_id") -> DataFrame:
    """Older overlap metric: phrases are extracted from both corpora and equi-joined
    on (entity, phrase, context_len). Only full-window phrases count in the
    numerator; context lengths without any overlap are absent (inner merge).
    Returns (context_len, overlap_count, total_count, overlap_ratio)."""
    cols = ["entity", "phrase", "context_len"]
    s = context_phrases(syn, entities, window=window, text_col=text_col, id_col=id_col).select(*cols)
    r = context_phrases(ref, entities, window=window, text_col=text_col, id_col=id_col).select(*cols)
    if remove_duplicates:
        s, r = s.dropDuplicates(cols), r.dropDuplicates(cols)
    full = F.size(F.split("phrase", " ")) == 2 * F.col("context_len") + F.size(
        F.filter(F.split("entity", r"(?U)\s+"), lambda x: x != F.lit("")))
    overlap = (r.join(s, cols, "inner").filter(full)
               .groupBy("context_len").agg(F.count("*").alias("overlap_count")))
    total = r.groupBy("context_len").agg(F.count("*").alias("total_count"))
    return (overlap.join(total, "context_len", "inner")
            .withColumn("overlap_ratio", F.col("overlap_count") / F.col("total_count")))
