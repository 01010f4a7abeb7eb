"""Text filters for generated records: normalisation, repetition gate,
discard rules, truncation, length filters. All per-row column expressions
(map-only, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_of, collapse_ws, last_period_prefix, strip_ws, ws_tokens


# The common English stop-word list used by the normaliser
# (the widely distributed NLTK English list, in its published order).
ENGLISH_STOPWORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself
yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having do does
did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()


def default_stopwords() -> list[str]:
    """The fixed English stop-word list (any list can be passed instead)."""
    return list(ENGLISH_STOPWORDS)


def normalise_text(text, stopwords: list[str] | None = None, lemmas: dict[str, str] | None = None) -> Column:
    """Keep ASCII letters and whitespace, lower-case, strip, drop stop words,
    map words through an optional lemma table, join with single spaces."""
    sw = default_stopwords() if stopwords is None else stopwords
    t = strip_ws(F.lower(F.regexp_replace(col_of(text), r"(?U)[^a-zA-Z\s]", "")))
    # IN over literals becomes a hash-set probe (InSet), not a list scan
    words = F.filter(ws_tokens(t), lambda w: ~w.isin(list(sw)))
    if lemmas:
        m = F.create_map(*[x for kv in lemmas.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
        words = F.transform(words, lambda w: F.coalesce(F.try_element_at(m, w), w))
    return F.array_join(words, " ")


def max_word_count(words: Column) -> Column:
    """Largest multiplicity of any element, from runs in the sorted array
    (per row, O(n log n), no explode or shuffle). 0 for an empty array."""
    init = F.struct(F.lit(None).cast("string").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc, x):
        run = F.when(x == acc["prev"], acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))
    return F.aggregate(F.array_sort(words), init, step, lambda acc: acc["best"])


def repetition_ok(text, pct: float = 0.15, max_count: int = 20) -> Column:
    """True iff no whitespace word occurs more than ``pct`` * #words times nor
    more than ``max_count`` times (empty text passes)."""
    w = ws_tokens(col_of(text))
    m = max_word_count(w)
    return (m <= F.size(w) * F.lit(pct)) & (m <= max_count)


def clean_none_markers(text) -> Column:
    """Remove 'None.', cut at the first 'None None', remove 'None.' again."""
    t = F.replace(col_of(text), F.lit("None."), F.lit(""))
    t = F.substring_index(t, "None None", 1)
    return F.replace(t, F.lit("None."), F.lit(""))


def discard_filter(df: DataFrame, text_col: str, *, discard_limit: int = 20, min_chars: int = 400,
                   stopwords: list[str] | None = None) -> DataFrame:
    """Adds the cleaned text (replacing ``text_col``), ``keep`` and ``reason``.

    Keep iff the normalised text has more than ``discard_limit`` distinct words,
    at least ``min_chars`` characters, and the cleaned (un-normalised) text
    passes the repetition gate. ``reason`` names the first failed rule.
    """
    cleaned = clean_none_markers(F.col(text_col))
    out = df.withColumn(text_col, cleaned).withColumn("_norm", normalise_text(collapse_ws(F.col(text_col)), stopwords))
    distinct_words = F.size(F.array_distinct(ws_tokens(F.lower("_norm"))))
    reason = (F.when(distinct_words <= discard_limit, F.lit("few_distinct_words"))
              .when(F.length("_norm") < min_chars, F.lit("too_short"))
              .when(~repetition_ok(F.col(text_col)), F.lit("repetitive")))
    return out.withColumn("reason", reason).withColumn("keep", F.col("reason").isNull()).drop("_norm")


def discard_data(df: DataFrame, text_col: str, **kw) -> DataFrame:
    """Rows that pass ``discard_filter``, with the cleaned text."""
    return discard_filter(df, text_col, **kw).filter("keep").drop("keep", "reason")


def truncate_to_last_period(df: DataFrame, text_col: str) -> DataFrame:
    return df.withColumn(text_col, last_period_prefix(F.col(text_col)))


def length_filters(df: DataFrame, text_col: str, *, min_chars: int | None = None,
                   max_tokens: int | None = None, tokens: Column | None = None) -> DataFrame:
    """Non-null text, ``length > min_chars``, ``#tokens < max_tokens``."""
    out = df.filter(F.col(text_col).isNotNull())
    if min_chars is not None:
        out = out.filter(F.length(text_col) > min_chars)
    if max_tokens is not None:
        t = tokens if tokens is not None else ws_tokens(F.col(text_col))
        out = out.filter(F.size(t) < max_tokens)
    return out
