"""Noun lemmas by suffix detachment, accepted against a vocabulary table.

Each word's candidates come from fixed endings; a candidate counts if the
vocabulary holds it (by default the words of the corpus itself); the shortest wins,
then the first. Distinct words meet the vocabulary in one join;
a document then takes up the lemmas of its own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ws_tokens
from .filters import normalise_text

# Noun endings and what stands in their place.
DETACHMENTS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
LEAST = 3  # letters of a candidate


def candidates(word: Column) -> Column:
    """The forms that the endings leave of a word."""
    forms = [F.when(F.endswith(word, F.lit(end)), F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(new))) for end, new in DETACHMENTS]
    return F.filter(F.array(*forms), lambda f: F.length(f) >= LEAST)


def lemma_table(words: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(word, lemma) of the words whose lemma is another word; both sides have a column ``word``."""
    distinct = words.select("word").distinct()
    known = (distinct if vocabulary is None else vocabulary.select("word").distinct()).withColumnRenamed("word", "form")
    forms = distinct.select("word", F.explode(candidates(F.col("word"))).alias("form")).join(known, "form")
    best = forms.groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "form")).alias("m"))
    return best.filter(F.col("m.n") <= F.length("word")).select("word", F.col("m.form").alias("lemma"))


def normalise_documents(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", vocabulary: DataFrame | None = None, lemmas: bool = True, out: str = "norm") -> DataFrame:
    """``docs`` with the normalised text (letters only, lower case, no stop words),
    its words lemmatised unless ``lemmas`` is false. A null text stays null."""
    rows = docs.withColumn(out, normalise_text(F.col(text_col)))
    if not lemmas:
        return rows
    words = rows.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(ws_tokens(F.col(out)))).alias("word"))
    table = lemma_table(words, vocabulary)
    maps = words.join(table, "word").groupBy("_id").agg(F.collect_set(F.struct("word", "lemma")).alias("_l"))
    both = rows.join(maps, rows[id_col].eqNullSafe(maps["_id"]), "left").drop("_id").withColumn("_m", F.map_from_entries("_l"))
    turned = F.array_join(F.transform(ws_tokens(F.col(out)), lambda w: F.coalesce(F.col("_m")[w], w)), " ")
    return both.withColumn(out, F.when(F.col("_m").isNull(), F.col(out)).otherwise(turned)).drop("_l", "_m")
