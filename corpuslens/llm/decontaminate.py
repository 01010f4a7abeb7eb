"""Benchmark decontamination by SimHash over item-sized windows (DataFrame functions only).

1. *Windows.* A window has as many words as the benchmark item it is held
   against. A window can only reach similarity ``t`` with an item of ``m``
   shingles if at most ``e = m - ceil(2 t m / (1 + t))`` of its shingles are not
   the item's; so one of its first ``e + 1`` and one of its last ``e + 1``
   shingles must be. Of the item's, a match of any length misses at most ``m - t m``,
   so it holds one of the rarest few that exceed this number: documents and items
   come together only over these, and a phrase that many share pairs none of them. Only windows that meet these
   conditions are fingerprinted; no window that could pass the check is left out.
2. *Fingerprints.* 64-bit SimHash of the window's words, repeats included, so an
   exchanged word moves few bits.
3. *Multi-index blocks.* The fingerprint is cut into ``blocks`` parts. Two
   fingerprints within ``radius`` bits differ by at most ``radius // blocks``
   bits in one of them, so the items are listed under all values that near each
   of their blocks and the windows look up their own: every pair within the
   radius is met.
4. *Check.* Similarity is the exact weighted Jaccard of word shingles (weights:
   how often a shingle occurs): sum of minima over sum of maxima, on the words.

Words are runs of letters and digits, lower case. Whole texts are scanned in one
map stage; shuffled are item shingles, the shingle positions found, and the few
windows. The documents' side of a join is skewed only by documents, each of
which has at most one window per word and item size.

Defined results: null and empty texts and items without a word match nothing; an
item of fewer words than a shingle is one shingle; a document shorter than the
item is one window; repeated documents are reported once; a null id is
reported as null; repeated items are reported each; a very long text is one row's
arrays of words and hashes; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BITS = 64


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def gram_hashes(w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
    return F.when(F.size(w) >= size, runs).otherwise(F.array().cast("array<bigint>"))


def grams(w: Column, size: Column) -> Column:
    """All runs of ``size`` words as texts (``size`` is at most the number of words)."""
    return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))


def with_simhash(df: DataFrame, words_col: str = "w", out: str = "fp") -> DataFrame:
    """Adds the majority bits of the words' 64-bit hashes; two 32-bit counters
    share a long. Each array is a projection of its own that later ones refer to
    more than once, so it is made once a row and not again for each element."""
    keep = df.columns
    df = df.withColumn("_hashes", F.transform(words_col, lambda x: F.xxhash64(x)))
    df = df.withColumn("_lanes", F.expr("transform(sequence(0, 31), j -> aggregate(_hashes, 0L, (a, h) -> a + (shiftrightunsigned(h, j) & 4294967297L)))"))
    half = "aggregate(sequence(0, 31), 0L, (a, j) -> a | if(2 * (shiftrightunsigned(_lanes[j], {0}) & 4294967295L) > size(_hashes), shiftleft(1L, j + {0}), 0L))"
    return df.select(*keep, F.expr(half.format(0)).bitwiseOR(F.expr(half.format(32))).alias(out))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the two multisets' counts."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    return F.when(a == b, F.lit(1.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def prepare_items(benchmark: DataFrame, id_col: str, text_col: str, shingle_words: int, threshold: float) -> DataFrame:
    """``(item_id, n, g, m, e, fp, grams)``: words, shingle length, number of
    shingles, shingles a match may miss, fingerprint, shingles."""
    rows = benchmark.select(F.col(f"`{id_col}`").alias("item_id"), words(F.col(f"`{text_col}`")).alias("w")).filter(F.size("w") > 0)
    rows = rows.withColumn("n", F.size("w")).withColumn("g", F.least("n", F.lit(shingle_words))).withColumn("m", F.col("n") - F.col("g") + 1)
    miss = F.col("m") - F.ceil(F.round(2 * threshold / (1 + threshold) * F.col("m"), 9)).cast("int")
    rows = with_simhash(rows.withColumn("e", miss))
    return rows.withColumn("grams", grams(F.col("w"), F.col("g"))).drop("w")


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.key") == F.col(f"{b}.key"))


def rarest(listed: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Of each item the shingles that documents hold least often, until they make
    up more than a match of any length may miss (``m - t m``, for a document
    shorter than the item): every match holds one of them."""
    missed = F.col("m") - F.ceil(F.round(threshold * F.col("m"), 9)).cast("int")
    often = found.groupBy("h").agg(F.count("*").alias("f"))
    ranked = listed.join(often, "h", "left").withColumn("f", F.coalesce("f", F.lit(0)))
    order = Window.partitionBy("item_id", "text").orderBy("f", "h").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0))).filter(F.col("before") <= missed).drop("before", "f", "c")


def _anchors(docs: DataFrame, items: DataFrame, broadcast_rows: int, threshold: float = 0.8) -> DataFrame:
    """Where documents hold a shingle of an item: ``(doc_id, key, n_doc, p, item_id,
    n, m, e)``, of the documents and items that share one of the item's rarest."""
    out = None
    for g in [r.g for r in items.select("g").distinct().collect()]:  # at most shingle_words values
        once = items.filter(F.col("g") == g).withColumn("text", F.xxhash64("grams")).dropDuplicates(["item_id", "text"])
        hashes = F.transform("grams", lambda x: F.xxhash64(*[F.get(F.split(x, " "), F.lit(k)) for k in range(g)]))  # noqa: B023
        listed = once.select("item_id", "text", "n", "m", "e", F.explode(hashes).alias("h")).groupBy("item_id", "text", "n", "m", "e", "h").agg(F.count("*").alias("c"))
        listed = materialise(listed, "item-shingles")
        wanted = listed.select("h").distinct()
        if wanted.count() <= broadcast_rows:  # 8 bytes each; above that, both sides are shuffled by h
            wanted = F.broadcast(wanted)
        found = (docs.select("doc_id", "key", F.size("w").alias("n_doc"), F.posexplode(gram_hashes(F.col("w"), g)).alias("p", "h"))
                 .join(wanted, "h"))
        found = materialise(found, "shingles-found")
        pairs = found.join(rarest(listed, found, threshold), "h").select("doc_id", "key", "item_id", "text", "n", "m", "e").distinct()
        own = found.alias("f").join(pairs.alias("o"), _same_document("f", "o")).select("f.doc_id", "f.key", "f.n_doc", "f.p", "f.h", "o.item_id", "o.text", "o.n", "o.m", "o.e")
        held = listed.select(F.col("item_id").alias("of"), F.col("text").alias("as"), F.col("h").alias("at"))
        found = own.join(held, own["item_id"].eqNullSafe(held["of"]) & (own["text"] == held["as"]) & (own["h"] == held["at"]), "left_semi")
        found = found.select("doc_id", "key", "n_doc", "p", "item_id", "n", "m", "e")
        out = found if out is None else out.unionByName(found)
    return out


def _windows(anchors: DataFrame) -> DataFrame:
    """Starts of the windows that may still pass: ``(doc_id, key, n, s)``."""
    last = F.greatest(F.col("n_doc") - F.col("n"), F.lit(0))
    place = lambda s: F.least(F.greatest(s, F.lit(0)), last)
    # flags: 1 a shingle among the first e + 1, 2 among the last; a window moved to fit the document counts as both
    flag = lambda s, f: F.struct(place(s).alias("s"), F.when(place(s) == s, F.lit(f)).otherwise(F.lit(3)).alias("f"))
    near = F.sequence(F.lit(0), F.col("e"))
    starts = F.concat(F.transform(near, lambda k: flag(F.col("p") - k, 1)), F.transform(near, lambda k: flag(F.col("p") - F.col("m") + 1 + k, 2)))
    return (anchors.select("doc_id", "key", "item_id", "n", F.explode(starts).alias("x"))
            .groupBy("doc_id", "key", "item_id", "n", F.col("x.s").alias("s")).agg(F.bit_or("x.f").alias("f")).filter("f = 3")
            .select("doc_id", "key", "n", "s").distinct())


def block_values(fp: Column, blocks: int, near: int | None = None) -> Column:
    """``(block, value)`` of each block; with ``near``, all values within so many bits."""
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        own = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
        if near is None:
            out.append(F.array(F.struct(F.lit(k).alias("block"), own.alias("value"))))
        else:
            masks = _masks(b - a, near)
            out.append(F.transform(F.lit(masks).cast("array<long>"), lambda m: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(m).alias("value"))))  # noqa: B023
    return F.concat(*out)


def _masks(width: int, near: int) -> list[int]:
    out, layer = [0], [0]
    for _ in range(min(near, width)):
        layer = sorted({m | 1 << b for m in layer for b in range(width) if not m >> b & 1})
        out += layer
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                 shingle_words: int = 5, threshold: float = 0.8, radius: int = 15, blocks: int = 4, broadcast_rows: int = 4_000_000) -> DataFrame:
    """``(id, text_key, item_id, similarity, hamming, start_word, n_words)``: the
    best window of every document and item it holds (ties: fewer bits, earlier);
    ``text_key`` is xxhash64 of the text, which tells apart texts of one id."""
    items = materialise(prepare_items(benchmark, item_id_col, item_text_col, shingle_words, threshold), "items")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("t"))
    texts = texts.filter(F.col("t").isNotNull()).select("doc_id", F.xxhash64("t").alias("key"), "t")
    anchors = _anchors(texts.select("doc_id", "key", words(F.col("t")).alias("w")), items, broadcast_rows, threshold)
    if anchors is None:  # no item has a word
        anchors = texts.limit(0).select("doc_id", "key", F.lit(0).alias("n_doc"), F.lit(0).alias("p")).join(items.select("item_id", "n", "m", "e"), F.lit(False))
    starts = materialise(_windows(anchors), "window-starts")
    held = starts.groupBy("doc_id", "key").agg(F.collect_set(F.struct("n", "s")).alias("at"))  # at most a window per word and item size
    rows = (texts.alias("d").join(materialise(held, "windows-by-document").alias("h"), _same_document("d", "h")).select("d.doc_id", "d.key", words(F.col("d.t")).alias("w"), "h.at")
            .select("doc_id", "key", "w", F.explode("at").alias("a")).select("doc_id", "key", "a.n", "a.s", F.slice("w", F.col("a.s") + 1, F.col("a.n")).alias("w")))
    windows = materialise(with_simhash(rows), "windows")
    index = items.select("item_id", "n", "fp", F.explode(block_values(F.col("fp"), blocks, radius // blocks)).alias("b")).select("item_id", "n", "b.*", F.col("fp").alias("item_fp"))
    probes = windows.select("doc_id", "key", "n", "s", "fp", F.explode(block_values(F.col("fp"), blocks)).alias("b")).select("doc_id", "key", "n", "s", "fp", "b.*")
    bits = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    pairs = (probes.join(index, ["n", "block", "value"]).withColumn("hamming", bits).filter(F.col("hamming") <= radius)
             .select("doc_id", "key", "n", "s", "item_id", "hamming").distinct())
    checked = (pairs.alias("p").join(windows.alias("x"), _same_document("p", "x") & (F.col("p.n") == F.col("x.n")) & (F.col("p.s") == F.col("x.s")))
               .join(items.alias("i"), F.col("p.item_id").eqNullSafe(F.col("i.item_id")) & (F.col("p.n") == F.col("i.n"))))
    held = checked.select("p.doc_id", "p.key", "p.item_id", "p.hamming", "p.s", "p.n", grams(F.col("x.w"), F.least(F.size("x.w"), F.lit(shingle_words))).alias("a"), F.col("i.grams").alias("b"))
    best = F.max(F.struct(weighted_jaccard(F.col("a"), F.col("b")).alias("similarity"), (-F.col("hamming")).alias("h"), (-F.col("s")).alias("s"), "n")).alias("b")
    return (held.groupBy("doc_id", "key", "item_id").agg(best).filter(F.col("b.similarity") >= threshold)
            .select(F.col("doc_id").alias(id_col), F.col("key").alias("text_key"), "item_id", "b.similarity", (-F.col("b.h")).alias("hamming"), (-F.col("b.s")).alias("start_word"), F.col("b.n").alias("n_words")))
