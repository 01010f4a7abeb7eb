"""Embedding- and LM-based quality scores of a synthetic corpus against a real one.

Embeddings are an input column (``array<float>``); everything below is
aggregation over them. Per-dimension work stays in the JVM (``posexplode`` +
``groupBy``); the d x d covariance uses Arrow batches (``mapInPandas``)
to form partial Gram matrices that Spark sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ws_tokens
from ..session import join_scalars, materialise
from .ngram_blocks import bigram_scores, token_blocks
from .tiles import tile_apply


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def centroid(emb: DataFrame, col: str = "embedding") -> DataFrame:
    """One row ``centroid``: the per-dimension mean (posexplode + groupBy(dim))."""
    per_dim = (emb.select(F.posexplode(F.col(col).cast("array<double>")).alias("dim", "v"))
               .groupBy("dim").agg(F.avg("v").alias("m")))
    return per_dim.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))),
                                   lambda s: s["m"]).alias("centroid"))


def centroid_cosine(syn: DataFrame, real: DataFrame, *, col: str = "embedding", id_col: str = "vec_id",
                    centroid_of: str = "synthetic") -> tuple[DataFrame, DataFrame]:
    """Cosine of every embedding to one corpus centroid.

    ``centroid_of='synthetic'`` reproduces the executed behaviour of the
    reference (its caller swaps the arguments); ``'real'`` is the documented
    one. Returns (scores per row with a ``corpus`` column, one-row summary
    with the mean score of each side).
    """
    base = syn if centroid_of == "synthetic" else real
    c = centroid(base, col)  # one row, d values
    def score(df, name):
        v = F.col(col).cast("array<double>")
        return join_scalars(df.select(id_col, v.alias("_v")), c).select(
            F.lit(name).alias("corpus"), id_col,
            F.try_divide(_dot(F.col("_v"), F.col("centroid")),
                         _norm(F.col("_v")) * _norm(F.col("centroid"))).alias("score"))
    scores = score(syn, "synthetic").unionByName(score(real, "real"))
    summary = scores.groupBy("corpus").agg(F.avg("score").alias("mean_score"))
    return scores, summary


# ---------------------------------------------------------------------------
# Fréchet distance between two Gaussian fits


def _gram_partials(col: str):
    def fn(it):
        n, s, g = 0, None, None
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf[col].to_numpy()).astype(np.float64)
            n += x.shape[0]
            s = x.sum(0) if s is None else s + x.sum(0)
            g = x.T @ x if g is None else g + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})
    return fn


_PARTIAL = T.StructType([T.StructField("n", T.LongType()),
                         T.StructField("s", T.ArrayType(T.DoubleType())),
                         T.StructField("g", T.ArrayType(T.DoubleType()))])


def whole_vectors(df: DataFrame, col: str) -> DataFrame:
    """The rows whose vector is there and holds only finite numbers."""
    vec = F.col(col).cast("array<double>")
    return df.filter(vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def moments(emb: DataFrame, col: str = "embedding", fan: int = 32) -> DataFrame:
    """One row (n, sum vector, Gram matrix flattened): a partial per partition,
    written once, then added up ``fan`` at a time. Rows without a whole vector
    take no part; without any row there is no result row."""
    emb = whole_vectors(emb, col)
    parts = emb.select(F.col(col).cast("array<double>").alias(col)).mapInPandas(_gram_partials(col), _PARTIAL)
    parts = materialise(parts.withColumn("slot", F.spark_partition_id().cast("long")), "gram-partials")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = lambda c: np.sum(np.stack(pdf[c].to_numpy()), axis=0).tolist()
        return pd.DataFrame({"n": [pdf["n"].sum()], "s": [total("s")], "g": [total("g")], "slot": [pdf["slot"].iloc[0]]})

    slots = (parts.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        slots = -(-slots // fan)
        parts = parts.withColumn("slot", F.expr(f"slot div {fan}")).groupBy("slot").applyInPandas(add, parts.schema)
        if slots == 1:
            return parts.drop("slot")


def frechet_distance(a: DataFrame, b: DataFrame, col: str = "embedding") -> DataFrame:
    """||mu_a - mu_b||^2 + Tr(S_a + S_b - 2 (S_a S_b)^(1/2)), sample covariances.

    Moments are Spark aggregates; the d x d eigen-decomposition (d = embedding
    width) runs on the driver on two d x d matrices. A side of fewer than two
    whole vectors has no covariance: the distance is NULL.
    """
    spark = a.sparkSession
    ma, mb = moments(a, col).first(), moments(b, col).first()
    n_a, n_b = (int(m["n"]) if m is not None else 0 for m in (ma, mb))
    if min(n_a, n_b) < 2:
        return spark.createDataFrame([(n_a, n_b, None)], "n_a long, n_b long, frechet double")

    def fit(m):
        n = m["n"]
        s = np.asarray(m["s"])
        d = s.shape[0]
        g = np.asarray(m["g"]).reshape(d, d)
        mu = s / n
        cov = (g - n * np.outer(mu, mu)) / (n - 1)
        return mu, cov

    mu1, s1 = fit(ma)
    mu2, s2 = fit(mb)
    # Tr((S1 S2)^1/2) = sum sqrt(eig(S1^1/2 S2 S1^1/2)), symmetric PSD form
    w, v = np.linalg.eigh(s1)
    r1 = (v * np.sqrt(np.clip(w, 0, None))) @ v.T
    ev = np.linalg.eigvalsh(r1 @ s2 @ r1)
    tr_sqrt = float(np.sqrt(np.clip(ev, 0, None)).sum())
    fd = float(((mu1 - mu2) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * tr_sqrt)
    return spark.createDataFrame([(n_a, n_b, fd)], "n_a long, n_b long, frechet double")


# ---------------------------------------------------------------------------
# MAUVE divergence frontier on cluster histograms

# Fixed values from the published MAUVE definition: 25 mixture weights in
# [1e-6, 1 - 1e-6] and exponent scaling 5.
MAUVE_GRID = 25
MAUVE_SCALE = 5.0


def mauve_from_histogram(hist: DataFrame, *, cluster: str = "cluster", corpus: str = "corpus",
                         count: str = "cnt", p_name: str = "synthetic", q_name: str = "real",
                         grid: int = MAUVE_GRID, scale: float = MAUVE_SCALE) -> DataFrame:
    """Area under the divergence frontier of two cluster histograms P, Q.

    For each weight w: R = wP + (1-w)Q, point (exp(-c KL(Q||R)), exp(-c KL(P||R))),
    plus the extremes (1, 0) and (0, 1); area by the trapezoid rule along the
    frontier (x ascending, y descending on ties), so identical histograms score
    1. The histogram has one row per (cluster, corpus).
    """
    weights = [1e-6 + i * ((1 - 2e-6) / (grid - 1)) for i in range(grid)]
    h = hist.groupBy(cluster).agg(
        F.sum(F.when(F.col(corpus) == p_name, F.col(count)).otherwise(0)).alias("cp"),
        F.sum(F.when(F.col(corpus) == q_name, F.col(count)).otherwise(0)).alias("cq"))
    tot = h.agg(F.sum("cp").alias("np"), F.sum("cq").alias("nq"))
    pq = join_scalars(h, tot).select(F.try_divide("cp", "np").alias("p"), F.try_divide("cq", "nq").alias("q"))
    wq = pq.select("p", "q", F.explode(F.array(*[F.lit(w) for w in weights])).alias("w"))
    r = F.col("w") * F.col("p") + (1 - F.col("w")) * F.col("q")
    kl = wq.groupBy("w").agg(
        F.sum(F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / r)).otherwise(0.0)).alias("kq"),
        F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / r)).otherwise(0.0)).alias("kp"))
    pts = kl.select(F.exp(-scale * F.col("kq")).alias("x"), F.exp(-scale * F.col("kp")).alias("y"))
    spark = hist.sparkSession
    ends = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0)], "x double, y double")
    allp = pts.unionByName(ends)
    # grid + 2 points: the ordered window is over a fixed-size table
    w = Window.orderBy("x", F.desc("y"))
    seg = allp.select("x", "y", F.lag("x").over(w).alias("x0"), F.lag("y").over(w).alias("y0"))
    return seg.agg(F.sum((F.col("x") - F.col("x0")) * (F.col("y") + F.col("y0")) / 2).alias("mauve"))


def mauve(syn: DataFrame, real: DataFrame, *, col: str = "embedding", k: int,
          pca_dims: int | None = None, seed: int = 25, max_iter: int = 50) -> DataFrame:
    """MAUVE: quantise the union of both embedding sets with k-means (optional
    PCA first), histogram each side over the clusters, take the frontier area."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    u = (syn.select(array_to_vector(F.col(col).cast("array<double>")).alias("features"),
                    F.lit("synthetic").alias("corpus"))
         .unionByName(real.select(array_to_vector(F.col(col).cast("array<double>")).alias("features"),
                                  F.lit("real").alias("corpus"))))
    feats = "features"
    if pca_dims:
        u = PCA(k=pca_dims, inputCol="features", outputCol="pca").fit(u).transform(u)
        feats = "pca"
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=feats, predictionCol="cluster").fit(u)
    hist = model.transform(u).groupBy("cluster", "corpus").agg(F.count("*").alias("cnt"))
    return mauve_from_histogram(hist)


# ---------------------------------------------------------------------------
# N-gram language model scores and perplexity

BOS = "<s>"


def lm_tokens(text: Column) -> Column:
    return F.concat(F.array(F.lit(BOS)), ws_tokens(F.lower(text)))


def ngram_lm_fit(ref: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Bigram LM counts from a reference corpus: (prev, tok, c2) and (prev, c1)."""
    t = ref.select(lm_tokens(F.col(text_col)).alias("_t"))
    pairs = t.select(F.explode(F.arrays_zip(F.slice("_t", 1, F.greatest(F.size("_t") - 1, F.lit(0))).alias("prev"),
                                            F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))).alias("tok")))
                     .alias("z")).select("z.prev", "z.tok")
    bigrams = pairs.groupBy("prev", "tok").agg(F.count("*").alias("c2"))
    ctx = bigrams.groupBy("prev").agg(F.sum("c2").alias("c1"))
    return bigrams, ctx


def ngram_token_logprobs(docs: DataFrame, model: tuple[DataFrame, DataFrame], vocab_size: DataFrame, *,
                         text_col: str = "text", id_col: str = "doc_id", k: float = 1.0) -> DataFrame:
    """(doc_id, pos, logp) with add-k smoothing: (c(prev,tok)+k) / (c(prev)+k V)."""
    bigrams, ctx = model
    t = docs.select(F.col(id_col).alias("doc_id"), lm_tokens(F.col(text_col)).alias("_t"))
    n = F.greatest(F.size("_t") - 1, F.lit(0))
    pairs = t.select("doc_id", F.posexplode(F.arrays_zip(F.slice("_t", 1, n).alias("prev"),
                                                         F.slice("_t", 2, n).alias("tok"))).alias("pos", "z")) \
        .select("doc_id", "pos", "z.prev", "z.tok")
    j = (pairs.join(bigrams, ["prev", "tok"], "left").join(ctx, "prev", "left"))
    j = join_scalars(j, vocab_size)
    return j.select("doc_id", "pos", F.log((F.coalesce("c2", F.lit(0)) + k)
                                           / (F.coalesce("c1", F.lit(0)) + k * F.col("V"))).alias("logp"))


def perplexity_from_logprobs(lp: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ppl): exp(-mean log-probability) per document."""
    return lp.groupBy("doc_id").agg(F.count("*").alias("n_tokens"),
                                    F.exp(-F.avg("logp")).alias("ppl"))


def lm_vocab_size(model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row ``V``: distinct tokens of the fitted corpus, including the start
    symbol. Every other token follows something, so it is a bigram's ``tok``;
    counting those avoids another pass over the text."""
    bigrams, _ = model
    return bigrams.agg((F.count_distinct("tok") + F.when(F.count("*") > 0, 1).otherwise(0)).alias("V"))


def write_lm(model: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The model's tables written once: (prev, tok, c2) and (prev, c1)."""
    bigrams = materialise(model[0], "bigrams")
    return bigrams, materialise(bigrams.groupBy("prev").agg(F.sum("c2").alias("c1")), "contexts")


def document_perplexity(docs: DataFrame, model: tuple[DataFrame, DataFrame], vocab_size: DataFrame, *,
                        text_col: str = "text", id_col: str = "doc_id", k: float = 1.0) -> DataFrame:
    """(doc_id, n_tokens, ppl) under a model of ``write_lm``.

    The texts are shuffled by id, so that equal bigrams and equal contexts of a
    document are counted in place; each list meets the one table that it needs,
    and a document's log-probability is the difference of the two sums.
    """
    bigrams, ctx = model
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartition("doc_id")
    t = texts.select("doc_id", lm_tokens(F.col("text")).alias("_t"))
    n = F.greatest(F.size("_t") - 1, F.lit(0))
    pairs = t.select("doc_id", F.explode(F.arrays_zip(F.slice("_t", 1, n).alias("prev"), F.slice("_t", 2, n).alias("tok"))).alias("z"))
    counts = pairs.groupBy("doc_id", "z.prev", "z.tok").agg(F.count("*").alias("n"))
    heads = t.select("doc_id", F.explode(F.slice("_t", 1, n)).alias("prev")).groupBy("doc_id", "prev").agg(F.count("*").alias("n"))
    after = counts.join(bigrams.select("prev", "tok", "c2"), ["prev", "tok"], "left") \
        .select("doc_id", "n", (F.col("n") * F.log(F.coalesce("c2", F.lit(0)) + k)).alias("_lp"))
    before = join_scalars(heads.join(ctx, "prev", "left"), vocab_size) \
        .select("doc_id", F.lit(0).cast("long").alias("n"), (-F.col("n") * F.log(F.coalesce("c1", F.lit(0)) + k * F.col("V"))).alias("_lp"))
    return (after.unionByName(before).groupBy("doc_id").agg(F.sum("n").alias("n_tokens"), F.sum("_lp").alias("_lp"))
            .select("doc_id", "n_tokens", F.exp(-F.col("_lp") / F.col("n_tokens")).alias("ppl")))


def corpus_perplexity(syn: DataFrame, ref: DataFrame, *, text_col: str = "text", id_col: str = "doc_id",
                      k: float = 1.0) -> DataFrame:
    """Per-document perplexities under a bigram LM fitted on ``ref`` and their mean
    per corpus: (corpus, n_docs, mean_perplexity)."""
    real = token_blocks(ref, lm_tokens(F.col(text_col)), id_col, 0, "real")
    synthetic = token_blocks(syn, lm_tokens(F.col(text_col)), id_col, 1, "synthetic")
    return corpus_means(bigram_scores(real, [synthetic], True, k))


def document_sums(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_tokens, ppl) from the rows (keys, n, lp) of documents."""
    sums = scored.groupBy(*keys).agg(F.sum("n").alias("n_tokens"), F.sum("lp").alias("lp"))
    return sums.select(*keys, "n_tokens", F.exp(-F.col("lp") / F.col("n_tokens")).alias("ppl"))


def corpus_means(scored: DataFrame) -> DataFrame:
    """(n_docs, mean_perplexity, corpus) of both corpora from (tag, doc_id, n, lp)."""
    means = document_sums(scored, "tag", "doc_id").groupBy("tag").agg(F.count("*").alias("n_docs"), F.avg("ppl").alias("mean_perplexity"))
    both = scored.sparkSession.createDataFrame([("synthetic",), ("real",)], "corpus string")
    return both.join(means, both["corpus"] == means["tag"], "left").select(F.coalesce("n_docs", F.lit(0)).alias("n_docs"), "mean_perplexity", "corpus")


def perplexity_from_losses(losses: DataFrame, *, key: str = "seq_id", loss: str = "loss") -> DataFrame:
    """exp(sum loss / #non-zero losses) per sequence (padding positions carry 0)."""
    return losses.groupBy(key).agg(
        F.exp(F.try_divide(F.sum(loss), F.count_if(F.col(loss) != 0))).alias("ppl"))


# ---------------------------------------------------------------------------
# Nearest real neighbour, shared entities


def nearest_real(syn: DataFrame, real: DataFrame, *, col: str = "embedding", id_col: str = "vec_id", k: int = 1,
                 syn_rows: int = 4096, real_rows: int = 16_384, fan: int = 32) -> DataFrame:
    """The k nearest real rows (cosine) of every synthetic row, exactly:
    (syn_id, rank, real_id, cosine), ties to the smaller id.

    Tiles of unit-normalised rows are multiplied; each keeps k rows a synthetic
    row, and the lists are merged ``fan`` at a time. Join the real ids back to
    the corpus for the texts. Ids may be of any type; rows without an id or a
    whole vector take no part, and a zero vector has cosine 0 with all.
    """
    rows = lambda df: materialise(whole_vectors(df.filter(F.col(id_col).isNotNull()), col).select(F.col(id_col).alias("id"), F.col(col).cast("array<double>").alias("v")), "vectors")
    s, r = rows(syn), rows(real)

    def unit(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(t.column("id").to_pylist())
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        return ids[order], v[order] / np.maximum(np.linalg.norm(v[order], axis=1, keepdims=True), 1e-300)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if a.num_rows and b.num_rows:
            part = b.column("_j")[0].as_py()
            (ids, x), (near, y) = unit(a), unit(b)
            for at in range(0, len(ids), 256):
                for i, row in zip(ids[at:at + 256].tolist(), x[at:at + 256] @ y.T):
                    least = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else row.min()
                    top = np.flatnonzero(row >= least)
                    top = top[np.argsort(-row[top], kind="stable")][:k]
                    for values, more in zip(out, ([i] * len(top), near[top].tolist(), row[top].tolist(), [part] * len(top))):
                        values += more
        return pa.table({"syn_id": pa.array(out[0], a.schema.field("id").type), "real_id": pa.array(out[1], b.schema.field("id").type),
                         "cosine": pa.array(out[2], pa.float64()), "part": pa.array(out[3], pa.int64())})

    kinds = [df.schema["id"].dataType.simpleString() for df in (s, r)]
    found = tile_apply(s, r, best, f"syn_id {kinds[0]}, real_id {kinds[1]}, cosine double, part long", left_key="id", right_key="id",
                       left_rows=syn_rows, right_rows=real_rows)
    parts = max(1, -(-r.count() // real_rows))
    while True:
        parts = -(-parts // fan)
        found = found.withColumn("part", F.expr(f"part div {fan}"))
        order = Window.partitionBy("syn_id", "part").orderBy(F.desc("cosine"), "real_id")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if parts == 1:
            return found.select("syn_id", "rank", "real_id", "cosine")
        found = found.drop("rank")


def shared_entity_documents(syn_mentions: DataFrame, ref_mentions: DataFrame) -> DataFrame:
    """(entity, doc_id): the real documents of every entity that some synthetic
    document mentions too. A lookup table from entities to texts, one row a
    mentioning document; no document pairs are formed."""
    wanted = syn_mentions.select("entity").distinct()
    return ref_mentions.select("entity", "doc_id").distinct().join(wanted, "entity", "left_semi")


def shared_entities(syn_mentions: DataFrame, ref_mentions: DataFrame) -> DataFrame:
    """For each synthetic document and entity it mentions: how many real
    documents mention the same entity (0 = synthetic-only entity).
    Aggregated per entity before the join, so no document pairs are formed."""
    ref_df = ref_mentions.select("doc_id", "entity").distinct().groupBy("entity") \
        .agg(F.count("*").alias("n_real_docs"))
    s = syn_mentions.select("doc_id", "entity").distinct()
    return s.join(ref_df, "entity", "left").select(
        "doc_id", "entity", F.coalesce("n_real_docs", F.lit(0)).alias("n_real_docs"))

