"""Entity and phrase search over a corpus as candidate equi-joins.

The naive plan for "which of these E entities occur in which of these D
documents" is a D x E nested loop of regex scans. Here every search is split
into

1. a *necessary* condition that is an equality on one token of the document,
2. the exact predicate (the regex or substring test), run only on the
   candidate pairs.

Whole-word entities (J1) name the token themselves. Substrings (J2, J3) may
begin and end inside a token, so the token is looked up first: the corpus'
distinct tokens meet the items' longest word through the rarest of its
character trigrams (an equi-join over the vocabulary, not over documents), and
the tokens that hold the word are the join keys. Up to ``MOST_SENT`` items (a
checked number) are sent to the texts and verified there; more items meet the
tokens in a shuffle join, where only ids and tokens move until the candidate
pairs meet the texts. No item needs a nested-loop join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, regex_escape, strip_chars, word_runs, ws_tokens
from ..session import join_scalars, materialise


def _longest(arr: Column) -> Column:
    """Longest element of a string array (ties: smallest), NULL when empty."""
    return F.array_min(F.transform(arr, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))["x"]


#: Items that are sent to all tasks; more meet the tokens in a shuffle join. Hash slots of the keys, which are sent then.
MOST_SENT, SLOTS = 100_000, 1 << 22


def keyed_pairs(docs: DataFrame, items: DataFrame, doc_tokens: Column, verify: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs x items`` where ``doc_tokens`` contains the item's ``_key``
    and ``verify`` holds; ``docs`` has ``doc_id`` and ``text`` (and ``keep``).

    Up to ``MOST_SENT`` items are sent to the texts: tokens meet the keys and
    candidates are verified where the text lies, in one pass without a shuffle
    (an item with several keys may come back several times for one text). Of more
    items the keys' hash slots are sent, the tokens in one of them meet the keys, and
    the pairs of numbers then the items and the texts.
    Streaming documents meet the static items directly (stateless).
    """
    exploded = docs.select("doc_id", "text", *keep, F.explode(F.array_distinct(doc_tokens)).alias("_tok"))
    if docs.isStreaming:
        return exploded.join(items, exploded["_tok"] == items["_key"]).filter(verify).drop("_tok", "_key")
    items = items.distinct()
    if len(items.select(F.lit(1)).limit(MOST_SENT + 1).collect()) <= MOST_SENT:
        return exploded.join(F.broadcast(items), exploded["_tok"] == items["_key"]).filter(verify).drop("_tok", "_key")
    slot = lambda key: F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_slot")
    own = [c for c in items.columns if c != "_key"]
    numbered = materialise(items.select(*own).distinct().withColumn("_item", F.monotonically_increasing_id()), "search-items")
    same = reduce(lambda x, y: x & y, [items[c].eqNullSafe(numbered[c]) for c in own])
    keys = materialise(items.join(numbered, same).select("_item", "_key"), "search-keys")
    tokens = docs.select(F.col("doc_id").alias("_doc"), F.explode(F.array_distinct(doc_tokens)).alias("_tok")).select("_doc", "_tok", slot("_tok"))
    tokens = tokens.join(F.broadcast(keys.select(slot("_key")).distinct()), "_slot", "left_semi")
    pairs = tokens.join(keys, tokens["_tok"] == keys["_key"]).select("_doc", "_item").distinct()
    rows = pairs.join(numbered, "_item").drop("_item")
    return rows.join(docs, rows["_doc"] == docs["doc_id"]).drop("_doc").filter(verify)


def _runs(text: Column) -> Column:
    """Maximal runs of non-space and of space characters, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+|\s+"), 0)


def _grams(word: Column, sizes: Column) -> Column:
    """Distinct substrings of the given lengths (code points)."""
    n = F.char_length(word)
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda k: k <= n), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(word, i, k)))))


def substring_keys(docs: DataFrame, items: DataFrame, needle: str) -> DataFrame:
    """``items`` with ``_key``: every document token that a text holding the
    needle must have (one item has as many rows as tokens fit).

    The needle's first run ends a token, its last begins one, inner runs are
    whole tokens, and a lone run lies inside one. The longest non-space run
    (inner runs first, then the longest space run) is used.
    """
    runs = _runs(F.col(needle))
    placed = F.transform(runs, lambda r, i: F.struct(
        F.when((i > 0) & (i < F.size(runs) - 1), 2).when(F.trim(F.regexp_replace(r, r"(?U)\s+", "")) != "", 1).otherwise(0).alias("rank"),
        F.char_length(r).alias("len"), r.alias("run"),
        F.when(F.size(runs) == 1, "holds").when(i == 0, "ends").when(i == F.size(runs) - 1, "starts").otherwise("equals").alias("how")))
    solid = F.filter(placed, lambda x: F.trim(F.regexp_replace(x["run"], r"(?U)\s+", "")) != "")
    chosen = items.withColumn("_p", F.array_max(F.when(F.size(solid) > 0, solid).otherwise(placed))).filter(F.col("_p").isNotNull())
    whole = chosen.filter(F.col("_p.how") == "equals").withColumn("_key", F.col("_p.run")).drop("_p")
    whole = whole.unionByName(items.filter(F.col(needle) == "").withColumn("_key", F.lit("")))
    part = chosen.filter(F.col("_p.how") != "equals")

    words = part.select("_p.run").distinct()
    if words.isEmpty():
        return materialise(whole, "needle-keys")
    size = F.least(F.lit(3), F.char_length("run"))
    wanted = words.select("run", F.explode(_grams(F.col("run"), F.array(size))).alias("gram"))
    sizes = words.agg(F.collect_set(size).alias("sizes"))  # some of 1, 2, 3
    vocabulary = docs.select(F.explode(F.array_distinct(_runs(F.col("text")))).alias("token")).distinct()
    grams = join_scalars(vocabulary, sizes).select("token", F.explode(_grams(F.col("token"), F.col("sizes"))).alias("gram"))
    grams = materialise(grams.join(wanted.select("gram").distinct(), "gram", "left_semi"), "vocabulary-grams")  # the only read of the texts here
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "gram").groupBy("run").agg(F.min(F.struct("n", "gram")).alias("m")) \
        .select("run", "m.gram")
    fits = grams.join(rarest, "gram").filter(F.contains("token", "run")).select("run", "token")
    how = F.col("_p.how")
    fit = (F.when(how == "ends", F.endswith(F.col("token"), F.col("_p.run")))
           .when(how == "starts", F.startswith(F.col("token"), F.col("_p.run"))).otherwise(F.lit(True)))
    keyed = part.join(fits, part["_p"]["run"] == fits["run"]).filter(fit).withColumn("_key", F.col("token"))
    return materialise(whole.unionByName(keyed.drop("_p", "run", "token")), "needle-keys")


def holding(docs: DataFrame, items: DataFrame, needle: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``docs x items`` whose ``text`` contains the needle, some perhaps repeated."""
    if docs.isStreaming:
        raise ValueError("substring search looks up the corpus vocabulary first; run it on a batch")
    return keyed_pairs(docs, substring_keys(docs, items, needle), F.concat(_runs(F.col("text")), F.array(F.lit(""))), F.contains(F.col("text"), F.col(needle)), keep)


# ---------------------------------------------------------------------------
# Case-insensitive whole-word entity search


def prepare_entities(entities: DataFrame, entity_col: str = "entity",
                     id_col: str = "entity_id") -> DataFrame:
    """Strip surrounding double quotes and build the leakage pattern."""
    clean = strip_chars(F.col(entity_col), '"')
    return entities.select(
        F.col(id_col).alias("entity_id"),
        clean.alias("entity"),
        F.concat(F.lit(r"(?iU)\b"), regex_escape(clean), F.lit(r"\b")).alias("_pat"),
        F.coalesce(_longest(word_runs(clean)), fold(clean)).alias("_key"),
    )


def neighbours(runs: Column) -> Column:
    """Every two word runs that follow each other, as one key (empty for fewer runs)."""
    n = F.greatest(F.size(runs) - 1, F.lit(0))
    return F.zip_with(F.slice(runs, F.lit(1), n), F.slice(runs, F.lit(2), n), lambda a, b: F.concat(a, F.lit("\x01"), b))


def _with_windows(rows: DataFrame, runs: str) -> DataFrame:
    """``rows`` with the hashes of every 2, 4 and 8 word runs in a row (``_w2``, ``_w4``, ``_w8``), from those of each run."""
    for at, step, to in ((runs, 1, "_w2"), ("_w2", 2, "_w4"), ("_w4", 4, "_w8")):
        n = F.greatest(F.size(at) - step, F.lit(0))
        rows = rows.withColumn(to, F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b)))
    return rows


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _marked(parts: Column) -> Column:
    """The parts with a mark wherever ``\\b`` is."""
    return F.concat(F.lit("\x01"), F.array_join(parts, "\x01"), F.when(F.size(parts) > 0, "\x01").otherwise(""))


#: Entities whose case-insensitive match is the equality of folded texts.
PLAIN = r"\A[A-Za-z0-9_](?:[ -~]*[A-Za-z0-9_])?\z"


def _by_windows(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs of documents and prepared entities that hold them. Keys are hashes of the entity's
    first 8 or 4 word runs, its longest 2, or of its only one; plain entities are then looked up
    as they are in the folded text with its word boundaries marked, others by their pattern."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    e = entities.repartition(n).withColumn("_plain", F.rlike("entity", F.lit(PLAIN))).withColumn("_runs", word_runs(F.col("entity")))
    e = _with_windows(e.withColumn("_h", _hashed(F.col("_runs"))), "_h")
    pairs = neighbours(F.col("_runs"))
    longest = F.get("_w2", F.array_position(pairs, _longest(pairs)).cast("int") - 1)
    key = (F.when(F.col("_plain") & (F.size("_w8") > 0), F.get("_w8", F.lit(0))).when(F.col("_plain") & (F.size("_w4") > 0), F.get("_w4", F.lit(0)))
           .when(F.size("_w2") > 0, longest).otherwise(F.xxhash64("_key")))
    look = _marked(F.regexp_extract_all(fold("entity"), F.lit(r"(?U)\w+|\W+"), 0))
    e = e.select("entity_id", "entity", F.when(F.col("_plain"), look).otherwise(F.col("_pat")).alias("_look"), "_plain", key.alias("_key"))
    e = materialise(e, "window-keys")  # long entities are cut once

    d = docs.withColumn("_parts", F.regexp_extract_all(fold("text"), F.lit(PARTS), 0))
    d = d.withColumn("_h", _hashed(F.col("_parts"))).withColumn("_h1", F.filter("_h", lambda _, i: i % 2 == 0))  # a gap follows each run but the last
    d = _with_windows(d, "_h1").select("doc_id", "text", _marked(F.col("_parts")).alias("_marked"), F.concat("_h", "_w2", "_w4", "_w8", F.when(F.size("_parts") > 0, F.array(F.xxhash64(F.lit("")))).otherwise(F.array().cast("array<bigint>"))).alias("_tokens"))
    verify = F.when(F.col("_plain"), F.contains("_marked", "_look")).otherwise(F.regexp(F.col("text"), F.col("_look")))
    return keyed_pairs(d, e, F.col("_tokens"), verify, ("_marked",))


def rarest_keys(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, _key): for each prepared entity, its word run with the
    smallest document frequency in ``docs`` (ties: longer, then smaller).

    One extra pass over the corpus: document runs are semi-joined to the
    entities' runs before counting, so only entity words are aggregated
    (partial aggregation, one row per entity word after the shuffle).
    """
    runs = entities.select("entity_id", F.explode(F.array_distinct(word_runs(F.col("entity")))).alias("run"))
    doc_runs = docs.select(F.explode(F.array_distinct(word_runs(F.col("text")))).alias("run"))
    dfreq = doc_runs.join(runs.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("_df"))
    ranked = runs.join(dfreq, "run", "left").select(
        "entity_id", "run", F.coalesce("_df", F.lit(0)).alias("_df"))
    return ranked.groupBy("entity_id").agg(
        F.min(F.struct("_df", (-F.length("run")).alias("_neg_len"), "run")).alias("_m")) \
        .select("entity_id", F.col("_m.run").alias("_key"))


#: Word runs and the gaps between two of them.
PARTS = r"(?U)\w+|(?<=\w)\W+(?=\w)"


def entity_tokens(text: Column) -> Column:
    """Tokens that entity keys are held against: word runs, the runs between
    two of them, and '' (the empty entity's key) where there is a word."""
    folded = fold(text)
    runs = F.regexp_extract_all(folded, F.lit(PARTS), 0)
    return F.concat(runs, F.when(F.regexp(folded, F.lit(r"(?U)\w")), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))


def entity_mentions(docs: DataFrame, entities: DataFrame, *, text_col: str = "text",
                    id_col: str = "doc_id", entity_col: str = "entity",
                    entity_id_col: str = "entity_id", key: str = "longest") -> DataFrame:
    """(doc_id, entity_id, entity) for every entity entry found in a document.

    Match rule: ``\\b<escaped entity>\\b``, case-insensitive, with the entity's
    surrounding double quotes removed. Entity entries of the same text and
    different ids each produce a row.

    Every ``\\w+`` run of a matching entity is a whole ``\\w+`` run of the
    document (the ``\\b`` anchors close the outer runs), so the entity's longest
    run is the join key. An entity without a word character must fill the whole
    gap between two word runs, so it is its own key. ``key='rarest'`` instead
    picks the run with the smallest document frequency (one extra corpus pass,
    fewer candidates when entities contain common words; batches only).
    ``key='neighbours'`` takes up to eight runs that follow each other (the only
    run, if there is one): for many entities of words that many documents hold.
    """
    if key not in ("longest", "rarest", "neighbours"):
        raise ValueError("key must be 'longest', 'rarest' or 'neighbours'")
    if key == "rarest" and docs.isStreaming:
        raise ValueError("key='rarest' counts the whole corpus; use key='longest' on a stream")
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .filter(F.col("text").isNotNull())
    e = prepare_entities(entities, entity_col, entity_id_col).filter(F.col("entity").isNotNull())
    if key == "rarest":
        e = e.join(rarest_keys(d, e).withColumnRenamed("_key", "_rare"), "entity_id", "left") \
            .withColumn("_key", F.coalesce("_rare", "_key")).drop("_rare")
    if key == "neighbours":
        return _by_windows(d, e).select("doc_id", "entity_id", "entity")
    verify = F.regexp(F.col("text"), F.col("_pat"))
    return keyed_pairs(d, e, entity_tokens(F.col("text")), verify).select("doc_id", "entity_id", "entity")


# ---------------------------------------------------------------------------
# J2 + X1: entity-in-context phrases (case-sensitive, no word boundary)


def context_phrases(docs: DataFrame, entities: DataFrame, *, window: int = 3,
                    text_col: str = "text", id_col: str = "doc_id",
                    entity_col: str = "entity", entity_id_col: str = "entity_id") -> DataFrame:
    """Phrases around each occurrence of an entity, with symmetric trims.

    For every non-overlapping match of
    ``((?:\\S+\\s+){0,W})<entity>((?:\\s+\\S+){0,W})`` the span's whitespace words
    ``words[w:n-w]`` (w = 0..W-1) that still contain the entity are emitted
    with ``context_len = W - w``.

    Output: (doc_id, entity_id, entity, match_no, phrase, context_len).
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_row")) \
        .filter(F.col("text").isNotNull())
    e = entities.filter(F.col(entity_col).isNotNull() & (F.length(entity_col) > 0)).select(
        F.col(entity_id_col).alias("entity_id"),
        F.col(entity_col).alias("entity"),
        F.concat(F.lit(r"(?U)((?:\S+\s+){0," + str(window) + "})"), regex_escape(F.col(entity_col)),
                 F.lit(r"((?:\s+\S+){0," + str(window) + "})")).alias("_pat"),
    )
    cand = holding(d, e, "entity", ("_row",))
    spans = cand.select(
        "_row", "doc_id", "entity_id", "entity",
        F.posexplode(F.regexp_extract_all(F.col("text"), F.col("_pat"), 0)).alias("match_no", "span"),
    )
    trims = spans.distinct().select("doc_id", "entity_id", "entity", "match_no",
                         ws_tokens(F.col("span")).alias("_w")) \
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("_t"))
    n = F.size("_w")
    phrase = F.array_join(F.slice(F.col("_w"), F.col("_t") + 1,
                                  F.greatest(n - 2 * F.col("_t"), F.lit(0))), " ")
    return (trims.select("doc_id", "entity_id", "entity", "match_no",
                         phrase.alias("phrase"), (F.lit(window) - F.col("_t")).alias("context_len"))
            .filter(F.contains(F.col("phrase"), F.col("entity"))))


# ---------------------------------------------------------------------------
# Phrase-in-any-reference-text semi join


def phrases_found_in(phrases: DataFrame, refs: DataFrame, *, phrase_col: str = "phrase",
                     text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Distinct phrases that are a substring of any ref text."""
    r = refs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .filter(F.col("text").isNotNull())
    p = phrases.select(F.col(phrase_col).alias("_phrase")).filter(F.col("_phrase").isNotNull()).distinct()
    return holding(r, p, "_phrase").select(F.col("_phrase").alias(phrase_col)).distinct()
