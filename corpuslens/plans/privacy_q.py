"""Privacy queries: leakage (J1, A4, A5), span memorisation."""

from __future__ import annotations

from ..operators import privacy, search
from . import roles
from .catalog import ENTS, REF, SYN, leak_hits, phrases_of, register


@register("leakage_pairs", leak_hits("documents") + "SELECT doc_id, entity_id, entity FROM hits")
def leakage_pairs(spark, sf):
    return search.entity_mentions(roles.documents(spark, sf), roles.entities(spark, sf))


@register("leakage_rollup", leak_hits(SYN) + f""",
agg AS (SELECT count(*) AS n_leaked, count(DISTINCT entity) AS nd FROM hits)
SELECT (SELECT count(*) FROM {SYN}) AS n_docs, n_leaked,
       round(n_leaked / (SELECT count(*) FROM {SYN}), 6) AS avg_leaked_per_doc,
       round(nd / (SELECT count(DISTINCT trim(entity, '"')) FROM {ENTS}), 6) AS share_entities_leaked
FROM agg""")
def leakage_rollup(spark, sf):
    return privacy.entity_leakage(roles.syn_docs(spark, sf), roles.entities(spark, sf))


@register("leakage_detail", leak_hits(SYN) + f"""
SELECT s.doc_id, CAST(coalesce(h.n, 0) AS BIGINT) AS n_leaked, coalesce(h.es, '') AS leaked_entities
FROM {SYN} s LEFT JOIN (
  SELECT doc_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(entity))), '|') AS es
  FROM hits GROUP BY doc_id) h ON s.doc_id = h.doc_id""")
def leakage_detail(spark, sf):
    return privacy.leakage_detail(roles.syn_docs(spark, sf), roles.entities(spark, sf))


_TEXTS = "(SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"


@register("leakage_report", leak_hits(_TEXTS) + f"""
SELECT (SELECT count(*) FROM {_TEXTS}) AS n_texts,
       round(coalesce((SELECT count(*) FROM hits), 0) / (SELECT count(*) FROM {_TEXTS}), 6) AS avg_leaked_per_doc,
       round(coalesce((SELECT sum(u) FROM (SELECT count(DISTINCT entity) AS u FROM hits GROUP BY doc_id)), 0)
             / (SELECT count(*) FROM {_TEXTS}), 6) AS avg_unique_leaked_per_doc,
       (SELECT count(DISTINCT entity) FROM hits) AS n_unique_leaked""")
def leakage_report(spark, sf):
    return privacy.leakage_report(roles.documents(spark, sf), roles.entities(spark, sf))


@register("epo_phrases", "WITH " + phrases_of(SYN)
          + "SELECT doc_id, entity_id, entity, phrase, context_len FROM phrases")
def epo_phrases(spark, sf):
    return search.context_phrases(roles.syn_docs(spark, sf), roles.entities(spark, sf), window=3) \
        .drop("match_no")


@register("epo_counts", "WITH " + phrases_of(SYN) + f""",
dd AS (SELECT DISTINCT entity, phrase, context_len FROM phrases)
SELECT context_len, count(*) AS count FROM dd
WHERE EXISTS (SELECT 1 FROM {REF} r WHERE contains(r.text, dd.phrase))
GROUP BY context_len""")
def epo_counts(spark, sf):
    return privacy.span_memorisation(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf),
                                     roles.entities(spark, sf), window=3)


@register("epo_overlap_ratio", "WITH " + phrases_of(SYN, "s_") + ", " + phrases_of(REF, "r_") + r""",
s AS (SELECT DISTINCT entity, phrase, context_len FROM s_phrases),
r AS (SELECT DISTINCT entity, phrase, context_len FROM r_phrases),
o AS (SELECT r.context_len, count(*) AS overlap_count FROM r JOIN s USING (entity, phrase, context_len)
      WHERE len(string_split(r.phrase, ' ')) = 2 * r.context_len
            + len(list_filter(string_split_regex(r.entity, '\s+'), lambda t: t <> ''))
      GROUP BY r.context_len),
t AS (SELECT context_len, count(*) AS total_count FROM r GROUP BY context_len)
SELECT o.context_len, overlap_count, total_count, round(overlap_count / total_count, 6) AS overlap_ratio
FROM o JOIN t USING (context_len)""")
def epo_overlap_ratio(spark, sf):
    return privacy.span_overlap_ratio(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf),
                                      roles.entities(spark, sf), window=3)


@register("epo_found_phrases", "WITH " + phrases_of(SYN) + f"""
SELECT DISTINCT phrase FROM phrases p
WHERE EXISTS (SELECT 1 FROM {REF} r WHERE contains(r.text, p.phrase))""")
def epo_found_phrases(spark, sf):
    ph = search.context_phrases(roles.syn_docs(spark, sf), roles.entities(spark, sf), window=3)
    return search.phrases_found_in(ph.select("phrase"), roles.ref_docs(spark, sf))


@register("leakage_pairs_rarest_key", leak_hits("documents") + "SELECT doc_id, entity_id, entity FROM hits")
def leakage_pairs_rarest_key(spark, sf):
    """Same hits as ``leakage_pairs``, keyed on each entity's rarest word."""
    return search.entity_mentions(roles.documents(spark, sf), roles.entities(spark, sf), key="rarest")
