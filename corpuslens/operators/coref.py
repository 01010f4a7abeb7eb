"""Coreference scoring on mention tables.

A clustering is a table ``(doc_key, cluster, start, end)``: one row per
mention of a cluster. Cluster keys are orderable; when a mention sits in two
clusters of one side, the larger key wins ("last cluster wins"). Scores are
corpus-level: numerators and denominators are summed over documents first.
Everything is grouped counts over one mention table, except the CEAF-e
assignment, solved per connected component of a document's overlaps in
``applyInPandas``.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.treebank import treebank_tokens
from ..session import join_scalars, materialise
from .components import component_roots
from .sentences import learn_abbreviations, with_sentences

M = ["doc_key", "start", "end"]
MOST_TOGETHER = 1000  # overlapping cluster pairs of a document that are assigned in one task


def mention_map(clusters: DataFrame) -> DataFrame:
    """(doc_key, start, end, other): each mention's cluster, last cluster wins."""
    return clusters.groupBy(*M).agg(F.max("cluster").alias("other"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("doc_key", "cluster").agg(F.count("*").alias("size"))


def mention_table(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_key, start, end, preds, golds): each mention with its clusters on both
    sides (as often as they occur). All scores are sums over this one table."""
    rows = pred.select(*M, F.col("cluster").alias("p"), F.lit(None).cast(gold.schema["cluster"].dataType).alias("g")) \
        .unionByName(gold.select(*M, F.lit(None).cast(pred.schema["cluster"].dataType).alias("p"), F.col("cluster").alias("g")))
    return rows.groupBy(*M).agg(F.collect_list("p").alias("preds"), F.collect_list("g").alias("golds"))


def _sizes(mentions: DataFrame, side: str) -> DataFrame:
    return mentions.select("doc_key", F.explode(side).alias("cluster")).groupBy("doc_key", "cluster").agg(F.count("*").alias("size"))


def _link_counts(mentions: DataFrame, side: str, other: str) -> DataFrame:
    """One row with the numerator and denominator of MUC, B-cubed and LEA for
    the clusters of ``side`` of a mention table; 0 where there are none.

    MUC: sums of (|c| - missing - linked) and (|c| - 1). B-cubed and LEA skip
    clusters of one mention; B-cubed gives no credit for the other side's.
    """
    sizes = _sizes(mentions, other).select("doc_key", F.col("cluster").alias("other"), F.col("size").alias("osize"))
    overlap = (mentions.select("doc_key", F.explode(side).alias("cluster"), F.array_max(other).alias("other"))
               .groupBy("doc_key", "cluster", "other").agg(F.count("*").alias("cnt")).join(sizes, ["doc_key", "other"], "left"))
    met, cnt = F.col("other").isNotNull(), F.col("cnt")
    per = overlap.groupBy("doc_key", "cluster").agg(
        F.sum(cnt).alias("size"), F.sum(F.when(~met, cnt).otherwise(0)).alias("missing"), F.count("other").alias("linked"),
        F.sum(F.when(met & (F.col("osize") != 1), cnt * cnt).otherwise(0)).alias("correct"),
        F.sum(F.when(met, cnt * (cnt - 1) / 2).otherwise(0.0)).alias("common"))
    size, many = F.col("size"), F.col("size") > 1
    total = lambda c: F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    over_many = lambda c: total(F.when(many, c))
    return per.agg(total(size - F.col("missing") - F.col("linked")).alias("muc_num"), total(size - 1).alias("muc_den"),
                   over_many(F.col("correct") / size).alias("b_cubed_num"), over_many(size).alias("b_cubed_den"),
                   over_many(2 * F.col("common") / (size - 1)).alias("lea_num"), over_many(size).alias("lea_den"))


def _one(metric: str):
    def counts(side: DataFrame, other: DataFrame) -> DataFrame:
        return _link_counts(mention_table(side, other), "preds", "golds").select(F.col(f"{metric}_num").alias("num"), F.col(f"{metric}_den").alias("den"))
    counts.__doc__ = f"One row (num, den) of {metric} for the clusters of ``side``."
    return counts


muc_counts, b_cubed_counts, lea_counts = _one("muc"), _one("b_cubed"), _one("lea")


def sparse_assignment(edges: list[tuple[int, int, float]]) -> float:
    """Greatest total weight of a one-to-one choice among weighted (row, column)
    edges, all weights positive: each row in turn takes the shortest augmenting
    path over the edges there are; a column of its own, of weight 0, stands for
    going without."""
    rows: dict[int, list[tuple[object, float]]] = {}
    for i, j, w in edges:
        rows.setdefault(i, []).append((j, -w))
    own: dict[object, int] = {}  # column -> its row
    taken: dict[int, object] = {}  # row -> its column
    u = {i: min(c for _, c in cols) for i, cols in rows.items()}
    v: dict[object, float] = {}
    for i, cols in rows.items():
        cols.append((("none", i), 0.0))
    for s in rows:
        dist: dict[object, float] = {}
        came: dict[object, int] = {}
        heap: list[tuple[float, int, object]] = []
        done: dict[object, float] = {}
        i, base, ticket = s, 0.0, 0
        while True:
            for j, c in rows[i]:
                d = base + c - u[i] - v.get(j, 0.0)
                if j not in done and d < dist.get(j, math.inf):
                    dist[j], came[j] = d, i
                    ticket += 1
                    heapq.heappush(heap, (d, ticket, j))
            while heap[0][2] in done:
                heapq.heappop(heap)
            base, _, end = heapq.heappop(heap)
            if end not in own:
                break
            done[end] = base
            i = own[end]
        for j, d in done.items():
            u[own[j]] += base - d
            v[j] = v.get(j, 0.0) + d - base
        u[s] += base
        while True:  # swap along the path
            i = came[end]
            own[end], taken[i], end = i, end, taken.get(i)
            if i == s:
                break
    weight = {(i, j): -c for i, cols in rows.items() for j, c in cols}
    return sum(weight[i, j] for j, i in own.items())


def _component_assignment(pdf: pd.DataFrame) -> pd.DataFrame:
    rows, columns = pd.factorize(pdf["gold"])[0], pd.factorize(pdf["pred"])[0]
    return pd.DataFrame({"sim": [sparse_assignment(list(zip(rows.tolist(), columns.tolist(), pdf["phi"].tolist())))]})


def _ceafe_counts(mentions: DataFrame, side: str = "preds", other: str = "golds") -> DataFrame:
    """One row (p_num, p_den, r_num, r_den) for CEAF-e: predicted singletons
    dropped, gold clusters kept; similarity phi4 = 2|g n c| / (|g| + |c|), best
    one-to-one assignment.

    The assignment falls apart into the connected components of the overlaps:
    pairs that touch no other pair are summed; documents of up to
    ``MOST_TOGETHER`` other overlaps are solved as they are, larger ones component
    by component, whatever the number of clusters of a document.
    """
    psz = _sizes(mentions, side).filter(F.col("size") != 1)
    gsz = _sizes(mentions, other)
    both = mentions.select("doc_key", F.array_distinct(other).alias("g"), F.array_distinct(side).alias("p"))
    inter = both.select("doc_key", "p", F.explode("g").alias("gold")).select("doc_key", "gold", F.explode("p").alias("pred")) \
        .groupBy("doc_key", "gold", "pred").agg(F.count("*").alias("i"))
    phi = (inter.join(gsz.withColumnRenamed("cluster", "gold").withColumnRenamed("size", "gs"), ["doc_key", "gold"])
           .join(psz.withColumnRenamed("cluster", "pred").withColumnRenamed("size", "ps"), ["doc_key", "pred"])
           .select("doc_key", F.concat(F.lit("g:"), F.col("gold").cast("string")).alias("gold"), F.concat(F.lit("p:"), F.col("pred").cast("string")).alias("pred"),
                   (2 * F.col("i") / (F.col("gs") + F.col("ps"))).alias("phi")))
    degree = lambda c: phi.groupBy("doc_key", c).agg(F.count("*").alias(f"{c}_n"))
    phi = materialise(phi.join(degree("gold"), ["doc_key", "gold"]).join(degree("pred"), ["doc_key", "pred"]), "overlaps")
    alone = (F.col("gold_n") == 1) & (F.col("pred_n") == 1)
    sims, linked = phi.filter(alone).select(F.col("phi").alias("sim")), phi.filter(~alone)
    large = linked.groupBy("doc_key").count().filter(F.col("count") > MOST_TOGETHER).select("doc_key")
    if large.isEmpty():
        sims = sims.unionByName(linked.groupBy("doc_key").applyInPandas(_component_assignment, schema="sim double"))
    else:
        large = materialise(large, "large-documents")
        few, many = linked.join(large, "doc_key", "left_anti"), linked.join(large, "doc_key", "left_semi")
        roots = component_roots(many.select("doc_key", F.col("gold").alias("u"), F.col("pred").alias("v")), "doc_key").withColumnRenamed("node", "gold")
        solved = many.join(roots, ["doc_key", "gold"]).groupBy("doc_key", "root").applyInPandas(_component_assignment, schema="sim double")
        sims = sims.unionByName(few.groupBy("doc_key").applyInPandas(_component_assignment, schema="sim double")).unionByName(solved)
    sim = sims.agg(F.coalesce(F.sum("sim"), F.lit(0.0)).alias("sim"))
    return join_scalars(sim, psz.agg(F.count("*").alias("p_den")), gsz.agg(F.count("*").alias("r_den"))).select(
        F.col("sim").alias("p_num"), F.col("p_den").cast("double").alias("p_den"), F.col("sim").alias("r_num"), F.col("r_den").cast("double").alias("r_den"))


def ceafe_counts(pred: DataFrame, gold: DataFrame) -> DataFrame:
    return _ceafe_counts(materialise(mention_table(pred, gold), "mentions"))


def _prf(p_num, p_den, r_num, r_den):
    p = F.when(p_num == 0, F.lit(0.0)).otherwise(p_num / p_den)
    r = F.when(r_num == 0, F.lit(0.0)).otherwise(r_num / r_den)
    pp = F.when(p_den == 0, F.lit(0.0)).otherwise(p_num / p_den)
    rr = F.when(r_den == 0, F.lit(0.0)).otherwise(r_num / r_den)
    f = F.when(pp + rr == 0, F.lit(0.0)).otherwise(2 * pp * rr / (pp + rr))
    return p, r, f


def coref_scores(pred: DataFrame, gold: DataFrame, with_lea: bool = False) -> DataFrame:
    """(metric, precision, recall, f1) for muc, b_cubed, ceafe and their mean ('avg')."""
    mentions = materialise(mention_table(pred, gold), "mentions")  # the only read of both sides
    p_side, r_side = _link_counts(mentions, "preds", "golds"), _link_counts(mentions, "golds", "preds")
    both = join_scalars(p_side.select(*[F.col(c).alias(f"p_{c}") for c in p_side.columns]),
                        r_side.select(*[F.col(c).alias(f"r_{c}") for c in r_side.columns]))
    both = materialise(both, "link-counts")  # one row, read once for each metric
    parts = [(name, both.select(*[F.col(f"{s}_{name}_{c}").alias(f"{s}_{c}") for s in "pr" for c in ("num", "den")]))
             for name in ("muc", "b_cubed", *(("lea",) if with_lea else ()))]
    parts.append(("ceafe", _ceafe_counts(mentions)))
    rows = None
    for name, df in parts:
        p, r, f = _prf(F.col("p_num"), F.col("p_den"), F.col("r_num"), F.col("r_den"))
        one = df.select(F.lit(name).alias("metric"), p.alias("precision"), r.alias("recall"), f.alias("f1"))
        rows = one if rows is None else rows.unionByName(one)
    avg = rows.filter(F.col("metric").isin("muc", "b_cubed", "ceafe")).agg(
        F.lit("avg").alias("metric"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"))
    return rows.unionByName(avg)


def mention_prf(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """One row (tp, fp, fn, precision, recall, f1) over distinct mentions."""
    p = pred.select(*M).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*M).distinct().withColumn("_g", F.lit(1))
    j = p.join(g, M, "full_outer").agg(
        F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"),
        F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))
    pr = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rc = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return j.select("tp", "fp", "fn", pr.alias("precision"), rc.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") > 0,
                     2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def metric_diff(a: DataFrame, b: DataFrame, key: str = "metric") -> DataFrame:
    """b - a for every numeric column of two metric tables joined on ``key``."""
    cols = [c for c, t in a.dtypes if c != key and t in ("double", "bigint", "int", "float")]
    j = a.alias("a").join(b.alias("b"), key)
    return j.select(key, *[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(f"{c}_diff") for c in cols])


def clusters_from_links(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Antecedent links (doc_key, mention, antecedent) -> (doc_key, mention, root).

    The antecedent always precedes the mention, so links form a forest; its
    components are the clusters. Pointer jumping: parent := parent(parent)
    until no pointer moves (<= log2(depth) + 1 rounds); raises if ``max_rounds`` do
    not suffice. Each round is written to the shared scratch folder.
    """
    nodes = links.select("doc_key", "mention", F.col("antecedent").alias("parent")).unionByName(
        links.select("doc_key", F.col("antecedent").alias("mention"), F.col("antecedent").alias("parent"))
    ).groupBy("doc_key", "mention").agg(F.min("parent").alias("parent"))
    # a mention that is only an antecedent points to itself; one with a link
    # points to its antecedent (which precedes it, hence is smaller)
    cur = nodes
    for _ in range(max_rounds):
        up = cur.select("doc_key", F.col("mention").alias("parent"), F.col("parent").alias("grand"))
        nxt = cur.join(up, ["doc_key", "parent"], "left").select(
            "doc_key", "mention", F.coalesce("grand", "parent").alias("parent"))
        nxt = materialise(nxt, "pointers")  # read by the next round and by the test for moves
        moved = nxt.join(cur.withColumnRenamed("parent", "_old"), ["doc_key", "mention"]) \
            .filter(F.col("parent") != F.col("_old")).limit(1).count()
        cur = nxt
        if moved == 0:
            return cur.withColumnRenamed("parent", "root")
    raise RuntimeError(f"links did not converge in {max_rounds} rounds")


def doc_stats(docs: DataFrame) -> DataFrame:
    """Corpus stats of nested coref documents: (max mentions per doc, max cluster
    size, max clusters per doc); -1 when there are no documents."""
    return docs.agg(
        F.coalesce(F.max(F.size(F.flatten("clusters"))), F.lit(-1)).alias("max_mentions"),
        F.coalesce(F.max(F.coalesce(F.array_max(F.transform("clusters", lambda c: F.size(c))), F.lit(0))),
                   F.lit(-1)).alias("max_cluster_size"),
        F.coalesce(F.max(F.size("clusters")), F.lit(-1)).alias("max_clusters"))


def attach_clusters(docs: DataFrame, predicted: DataFrame, key: str = "doc_key",
                    col: str = "clusters") -> DataFrame:
    """Left join predicted clusters onto documents; documents without a
    prediction get an empty cluster list."""
    p = predicted.select(key, F.col(col).alias("_pc"))
    j = docs.join(p, key, "left")
    return j.withColumn(col, F.coalesce("_pc", F.array().cast(p.schema["_pc"].dataType))).drop("_pc")


def nest_clusters(mentions: DataFrame) -> DataFrame:
    """(doc_key, cluster, start, end) -> (doc_key, clusters: array<array<array<int>>>),
    clusters ordered by key, mentions by position."""
    per = mentions.groupBy("doc_key", "cluster").agg(
        F.array_sort(F.collect_list(F.array(F.col("start").cast("int"), F.col("end").cast("int")))).alias("c"))
    return per.groupBy("doc_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cluster", "c"))), lambda s: s["c"]).alias("clusters"))


def sentences(df: DataFrame, text_col: str = "text", key: str = "doc_key", abbreviations: DataFrame | None = None) -> DataFrame:
    """Coref-style documents: sentences (cut by abbreviations learnt from ``df``
    unless given) as Treebank tokens; speakers '-' per token; empty annotations."""
    learnt = learn_abbreviations(df, text_col=text_col) if abbreviations is None else abbreviations
    cut = with_sentences(df.select(F.col(key).cast("string").alias("doc_key"), F.col(text_col).alias("text")), learnt, id_col="doc_key", out="_s")
    d = cut.select("doc_key", F.transform("_s", treebank_tokens).alias("sentences"))
    return d.select("doc_key", "sentences",
                    F.transform("sentences", lambda s: F.transform(s, lambda _: F.lit("-"))).alias("speakers"),
                    F.array().cast("array<string>").alias("constituents"),
                    F.array().cast("array<string>").alias("ner"),
                    F.array().cast("array<array<array<int>>>").alias("clusters"))
