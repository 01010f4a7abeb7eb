"""Time the naive cross-join plans of J1, A6, A9 and A11 against the library's.

Usage: python tools/naive_baseline.py [sf_dir [J1 A6 A9 A11]]   (default /root/testdata/sf0.01, all)
Prints one Markdown table row per metric; both sides give the same numbers.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from corpuslens.functions.text import regex_escape, strip_chars, ws_tokens  # noqa: E402
from corpuslens.operators import privacy, search, similarity  # noqa: E402
from corpuslens.plans import roles  # noqa: E402
from corpuslens.session import get_session  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    docs, ents = roles.documents(spark, sf).select("doc_id", "text").repartition(8), roles.entities(spark, sf)
    syn, ref = roles.syn_docs(spark, sf).repartition(8), roles.ref_docs(spark, sf).repartition(8)

    def j1():
        clean = strip_chars(F.col("entity"), '"')
        return docs.crossJoin(ents).filter(F.regexp("text", F.concat(F.lit(r"(?iU)\b"), regex_escape(clean), F.lit(r"\b")))).count()

    def a6():
        phrases = search.context_phrases(syn, ents).select("entity", "phrase", "context_len").distinct()
        return phrases.crossJoin(ref).filter(F.contains("text", "phrase")).select("entity", "phrase", "context_len").distinct().count()

    def a9():
        x, y, _ = similarity.tfidf(syn, ref)
        a = x.groupBy(F.col("doc_id").alias("i")).agg(F.map_from_entries(F.collect_list(F.struct("term", "x"))).alias("a"))
        b = y.groupBy(F.col("doc_id").alias("j")).agg(F.collect_list(F.struct("term", "x")).alias("b"))
        dot = F.aggregate("b", F.lit(0.0), lambda s, t: s + F.coalesce(F.col("a")[t["term"]], F.lit(0.0)) * t["x"])
        return a.crossJoin(b).agg(F.sum(dot)).first()[0] / syn.count() / ref.count()

    def a11():
        a = syn.select(F.array_distinct(ws_tokens(F.col("text"))).alias("a"))
        b = ref.select(F.array_distinct(ws_tokens(F.col("text"))).alias("b"))
        n = F.size(F.array_intersect("a", "b"))
        return a.crossJoin(b).agg(F.avg(n / (F.size("a") + F.size("b") - n))).first()[0]

    def cosine():
        x, y, _ = similarity.tfidf(syn, ref)
        size = lambda d: d.agg(F.count("*").alias("n"))
        return similarity.cosine_mean(x, y, size(syn), size(ref)).first()[0]

    cases = {
        "J1 entity search": (j1, lambda: search.entity_mentions(docs, ents).count()),
        "A6 span memorisation": (a6, lambda: privacy.span_memorisation(syn, ref, ents).agg(F.sum("count")).first()[0]),
        "A9 mean cosine": (a9, cosine),
        "A11 mean Jaccard": (a11, lambda: similarity.jaccard_mean(syn, ref).first()[0]),
    }
    search.entity_mentions(docs, ents).count()  # warm-up
    wanted = sys.argv[2:]
    for name, (naive, ours) in cases.items():
        if wanted and name.split()[0] not in wanted:
            continue
        row = []
        for f in (naive, ours):
            began = time.time()
            value = f()
            row += [f"{time.time() - began:.1f}", value]
        print(f"| {name} | {row[0]} | {row[2]} | {row[1]:.6g} / {row[3]:.6g} |", flush=True)


if __name__ == "__main__":
    main()
