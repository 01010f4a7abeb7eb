"""Dictionary entities in text: a token trie as a join table.

A node of the trie is the hash of a phrase prefix at its depth; a place in a
document walks down the trie by one equi-join a level on the hash of its own
first ``k`` tokens. Every place follows one path, so a level never holds more
rows than the level above, however many phrases share their first words, and
phrases may have any length. Of overlapping hits the leftmost wins, then the
longest; only hits that overlap one another are looked at together.

Tokens are word runs and single other characters; matching is case-sensitive.
Prefix hashes have 64 bits and are compared level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

TOKEN = r"(?U)\w+|[^\w\s]"


def phrase_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), 0)


def _step(h: Column, token: Column) -> Column:
    return F.xxhash64(h, token)


def token_trie(dictionary: DataFrame, *, entity_col: str = "entity", label_col: str = "label") -> DataFrame:
    """(depth, node, entry): entry (entity, label) where a phrase ends. Phrases of
    equal tokens are one entry, the smallest; phrases without a token are left out."""
    phrases = dictionary.select(phrase_tokens(F.col(entity_col)).alias("t"), F.struct(F.col(entity_col).alias("entity"), F.col(label_col).alias("label")).alias("e")) \
        .filter(F.size("t") > 0)
    nodes = phrases.select("t", "e", F.explode(F.sequence(F.lit(1), F.size("t"))).alias("depth"))
    node = F.reduce(F.slice("t", 1, F.col("depth")), F.lit(0).cast("long"), _step)
    return nodes.groupBy("depth", node.alias("node")).agg(F.min(F.when(F.col("depth") == F.size("t"), F.col("e"))).alias("entry"))


def _places(docs: DataFrame, depth: int) -> DataFrame:
    """(doc_id, pos, h1..hk): each token's place with the hashes of the 1..k tokens from it on (null past the end)."""
    rows = docs.withColumn("h1", F.transform("t", lambda x: _step(F.lit(0).cast("long"), x)))
    for k in range(2, depth + 1):
        left = F.greatest(F.size("t") - (k - 1), F.lit(0))
        rows = rows.withColumn(f"h{k}", F.zip_with(F.slice(F.col(f"h{k - 1}"), F.lit(1), left), F.slice("t", F.lit(k), left), _step))
    hashes = [f"h{k}" for k in range(1, depth + 1)]
    return rows.select("doc_id", F.posexplode(F.arrays_zip(*hashes)).alias("pos", "h")).select("doc_id", "pos", *[F.col(f"h.{h}") for h in hashes])


def phrase_hits(docs: DataFrame, dictionary: DataFrame, *, text_col: str = "text", id_col: str = "doc_id",
                entity_col: str = "entity", label_col: str = "label") -> DataFrame:
    """(doc_id, pos, n_tokens, entity, label): the longest phrase at each token that begins one."""
    trie = materialise(token_trie(dictionary, entity_col=entity_col, label_col=label_col), "token-trie")
    depth = trie.agg(F.max("depth")).first()[0] or 0
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), phrase_tokens(F.col(text_col)).alias("t"))
    entry = trie.schema["entry"].dataType
    hits = _places(rows, max(depth, 1)).withColumn("alive", F.lit(True)).withColumn("n_tokens", F.lit(0)).withColumn("entry", F.lit(None).cast(entry))
    for k in range(1, max(depth, 1) + 1):
        level = trie.filter(F.col("depth") == k).select(F.col("node").alias("_node"), F.col("entry").alias("_entry"))
        # a place whose path has ended only carries its best phrase: it gets a key of its own
        key = F.when(F.col("alive") & F.col(f"h{k}").isNotNull(), F.col(f"h{k}")).otherwise(F.xxhash64("doc_id", "pos"))
        met = hits.withColumn("_key", key).join(level, F.col("_key") == F.col("_node"), "inner" if k == 1 else "left")
        goes_on = F.col("alive") & F.col(f"h{k}").isNotNull() & F.col("_node").isNotNull()
        ends = goes_on & F.col("_entry").isNotNull()
        hits = met.select("doc_id", "pos", *[f"h{j}" for j in range(k + 1, depth + 1)], goes_on.alias("alive"),
                          F.when(ends, k).otherwise(F.col("n_tokens")).alias("n_tokens"), F.when(ends, F.col("_entry")).otherwise(F.col("entry")).alias("entry")) \
            .filter(F.col("alive") | (F.col("n_tokens") > 0))
    return hits.filter(F.col("n_tokens") > 0).select("doc_id", "pos", "n_tokens", "entry.entity", "entry.label")


def leftmost_longest(hits: DataFrame) -> DataFrame:
    """Of overlapping hits the leftmost, then the longest, until none overlap.

    Hits are cut into runs that overlap no other run (one sort by document and
    place); the choice inside a run is one fold over its hits.
    """
    by_place = Window.partitionBy("doc_id").orderBy("pos", F.desc("n_tokens"))
    before = F.max(F.col("pos") + F.col("n_tokens")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    opened = hits.withColumn("_opens", F.when(F.col("pos") < before, 0).otherwise(1))
    runs = opened.withColumn("_run", F.sum("_opens").over(by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own = F.struct("pos", "n_tokens", "entity", "label")
    lists = runs.groupBy("doc_id", "_run").agg(F.collect_list(own).alias("l"))
    ordered = F.array_sort("l", lambda a, b: F.when(a["pos"] != b["pos"], a["pos"] - b["pos"]).otherwise(b["n_tokens"] - a["n_tokens"]))
    lists = lists.select("doc_id", ordered.alias("l"))
    start = F.struct(F.lit(0).alias("free"), F.slice("l", 1, 0).alias("kept"))
    fold = F.reduce("l", start, lambda s, x: F.when(x["pos"] >= s["free"], F.struct((x["pos"] + x["n_tokens"]).alias("free"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s))
    return lists.select("doc_id", F.explode(fold["kept"]).alias("x")).select("doc_id", "x.*")


def gazetteer_entities(docs: DataFrame, dictionary: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, pos, n_tokens, entity, label): the dictionary's phrases in each
    document, leftmost-longest; ``pos`` counts tokens. Null texts hold none."""
    return leftmost_longest(phrase_hits(docs, dictionary, **columns))
