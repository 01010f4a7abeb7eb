"""Sentences, with abbreviations learnt from the corpus.

A word type is an abbreviation if its final period belongs to it: Kiss and
Strunk's log-likelihood ratio of (word, period) pairs, scaled by the word's
length, its inner periods and how often it stands without a period. The counts
are grouped sums over the corpus; what a document needs of the result is the
list of its own words that are abbreviations, so the cuts are made in the row;
a short list goes to all texts, and they are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.treebank import treebank_tokens
from ..session import join_scalars, materialise

#: Characters that may close a sentence after its last mark, and open a word.
CLOSERS = r"""["')\]]*"""
STOP = "\x01"
JOIN = "\x02"
#: Up to so many abbreviations go to all texts; of more, a text gets its own.
FEW = 10_000


def word_type(word: Column) -> Column:
    """The word without outer punctuation; a final period stays."""
    return F.regexp_replace(F.regexp_replace(word, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}.]+$", "")


def learn_abbreviations(docs: DataFrame, *, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """(word, score): the types, without their period, that score ``least`` or more.
    Lower-case whitespace words are counted before each is stripped to its type."""
    raw = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    words = raw.select(word_type(F.col("raw")).alias("w"), "n").filter(F.col("w").rlike(r"\p{L}"))
    ends = F.endswith(F.col("w"), F.lit("."))
    times = lambda kind: F.sum(F.when(kind, F.col("n")).otherwise(0))
    counts = words.groupBy(F.regexp_replace("w", r"\.$", "").alias("word")).agg(times(ends).alias("with"), times(~ends).alias("without"))
    total = counts.agg(F.sum(F.col("with") + F.col("without")).alias("n"), F.sum("with").alias("dots"))
    c = join_scalars(counts.filter("with > 0"), total)
    share = F.col("dots") / F.col("n")
    null = F.col("with") * F.log(share) + F.when(F.col("without") > 0, F.col("without") * F.log(1 - share)).otherwise(0.0)
    alternative = F.col("with") * F.log(F.lit(0.99)) + F.col("without") * F.log(F.lit(0.01))
    dots = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."))) + 1
    letters = F.length("word") - dots + 1
    score = -2 * (null - alternative) * F.exp(-letters) * dots * F.pow(letters.cast("double"), -F.col("without").cast("double"))
    return c.filter(F.col("dots") < F.col("n")).select("word", score.alias("score")).filter(F.col("score") >= least)


def _pieces(text: Column) -> Column:
    """The text cut at white space after every ``.``, ``!`` or ``?``."""
    return F.split(F.regexp_replace(text, f"([.!?]{CLOSERS})\\s+", f"$1{STOP}"), STOP)


def _last_word(piece: Column) -> Column:
    """The piece's last word as a type, if a single period ends it; else null."""
    last = F.regexp_extract(F.substring_index(piece, " ", -1), r"(\S+)\.$", 1)
    return F.when(~F.endswith(piece, F.lit("..")), F.nullif(F.regexp_replace(F.lower(last), r"^[^\p{L}\p{N}]+", ""), F.lit("")))


def with_sentences(docs: DataFrame, abbreviations: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", out: str = "sentences") -> DataFrame:
    """``docs`` with its sentences (trimmed, none empty): cut at white space after
    ``.``, ``!`` or ``?`` unless the word before is one of the abbreviations. A
    null text has no sentences; white space at a kept place becomes one blank."""
    rows = docs.withColumn("_pieces", F.coalesce(_pieces(F.col(text_col)), F.array().cast("array<string>")))
    words = materialise(abbreviations.select("word").filter("word is not null"), "abbreviations")
    few = [r["word"] for r in words.limit(FEW + 1).collect()]
    if len(few) <= FEW:
        known = lambda p: _last_word(p).isin(few)
    else:
        asked = rows.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(F.transform("_pieces", _last_word))).alias("word")).filter("word is not null")
        own = asked.join(words, "word", "left_semi").groupBy("_id").agg(F.collect_set("word").alias("_own"))
        rows = rows.join(own, rows[id_col].eqNullSafe(own["_id"]), "left").drop("_id")
        known = lambda p: F.array_contains("_own", _last_word(p))
    kept = F.array_join(F.transform("_pieces", lambda p: F.concat(p, F.when(F.coalesce(known(p), F.lit(False)), F.lit(" ")).otherwise(F.lit(JOIN)))), "")
    cut = F.filter(F.transform(F.split(kept, JOIN), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != F.lit(""))
    return rows.withColumn(out, cut).drop("_pieces", "_own")


def treebank_documents(docs: DataFrame, abbreviations: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", out: str = "tokens") -> DataFrame:
    """``docs`` with its lower-case Treebank tokens, sentence by sentence."""
    rows = with_sentences(docs, abbreviations, text_col=text_col, id_col=id_col, out="_sentences")
    return rows.withColumn(out, F.flatten(F.transform("_sentences", lambda s: treebank_tokens(F.lower(s))))).drop("_sentences")
