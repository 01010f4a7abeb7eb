"""Registered queries over the driver's tables, each with its DuckDB twin.

Every query reads whole tables (see ``roles``); doubles are rounded to 6
places and integer columns are BIGINT in both engines so results hash alike.
A query without SQL twin is checked on rows only (non-SQL operators: model
fits, iterative algorithms).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (lambda spark, sf_dir: normalise(fn(spark, sf_dir)), sql)
        return fn
    return deco


def normalise(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 places, integral types widened to BIGINT."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---------------------------------------------------------------------------
# Shared SQL fragments (DuckDB). RE2's \w, \s and \b are ASCII, so word
# characters are spelled out as [\p{L}\p{N}_] to match Java's (?U)\w.

SYN = "(SELECT doc_id, text FROM documents WHERE CAST(substr(source, 4) AS INTEGER) >= 10)"
REF = "(SELECT doc_id, text FROM documents WHERE CAST(substr(source, 4) AS INTEGER) < 10)"
# one to four words of an item, from its longest word on (not among the last three; ties: the smallest)
_FIRST = "list_slice(string_split(text, ' '), 1, greatest(len(string_split(text, ' ')) - 3, 1))"
_LONG = (f"list_reduce({_FIRST}, lambda a, x: CASE WHEN length(x) > length(a) OR (length(x) = length(a) AND x < a) "
         "THEN x ELSE a END)")
ENTS = (f"(SELECT item_id AS entity_id, array_to_string(list_slice(string_split(text, ' '), list_position({_FIRST}, {_LONG}), "
        f"list_position({_FIRST}, {_LONG}) + item_id % 4), ' ') AS entity FROM benchmark)")
WS = r"list_filter(string_split_regex({x}, '\s+'), lambda t: t <> '')"


def ws(x: str) -> str:
    return WS.format(x=x)


LEAK_HITS = rf"""
pats AS (
  SELECT entity_id, entity,
    '(?i)' ||
    CASE WHEN regexp_matches(entity, '^[\p{{L}}\p{{N}}_]') THEN '(^|[^\p{{L}}\p{{N}}_])' ELSE '[\p{{L}}\p{{N}}_]' END ||
    regexp_escape(entity) ||
    CASE WHEN regexp_matches(entity, '[\p{{L}}\p{{N}}_]$') THEN '($|[^\p{{L}}\p{{N}}_])' ELSE '[\p{{L}}\p{{N}}_]' END AS pat
  FROM (SELECT entity_id, trim(entity, '"') AS entity FROM {ENTS})
),
cand AS MATERIALIZED (
  SELECT d.doc_id, d.text, p.entity_id, p.entity, p.pat
  FROM {{docs}} d JOIN pats p ON contains(lower(d.text), lower(p.entity))
),
hits AS (SELECT doc_id, entity_id, entity FROM cand WHERE regexp_matches(text, pat))
"""


def leak_hits(docs: str) -> str:
    return "WITH " + LEAK_HITS.replace("{docs}", docs)


PHRASES = rf"""
cand AS MATERIALIZED (
  SELECT s.doc_id, s.text, e.entity_id, e.entity,
         '((?:\S+\s+){{0,3}})' || regexp_escape(e.entity) || '((?:\s+\S+){{0,3}})' AS pat
  FROM {{docs}} s JOIN {ENTS} e ON contains(s.text, e.entity)
),
spans AS (SELECT doc_id, entity_id, entity, unnest(regexp_extract_all(text, pat)) AS span FROM cand),
words AS (SELECT doc_id, entity_id, entity, {ws('span')} AS w FROM spans),
trims AS (SELECT doc_id, entity_id, entity, w, unnest(range(0, 3)) AS t FROM words),
phrases AS (
  SELECT doc_id, entity_id, entity,
         array_to_string(list_slice(w, t + 1, len(w) - t), ' ') AS phrase,
         CAST(3 - t AS BIGINT) AS context_len
  FROM trims WHERE contains(array_to_string(list_slice(w, t + 1, len(w) - t), ' '), entity)
)
"""


def phrases_of(docs: str, prefix: str = "") -> str:
    body = PHRASES.replace("{docs}", docs)
    if prefix:
        for name in ("cand", "spans", "words", "trims", "phrases"):
            body = body.replace(f"{name} AS", f"{prefix}{name} AS").replace(
                f"FROM {name}", f"FROM {prefix}{name}")
    return body


def sentences_sql(docs: str) -> str:
    """CTEs that learn abbreviations from ``docs`` (id, text) and ``sents`` (id, s): each text's sentences."""
    word = r"regexp_replace(regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+', ''), '[^\p{{L}}\p{{N}}.]+$', '')"
    last = r"""CASE WHEN NOT ends_with(p, '..') THEN nullif(regexp_replace(lower(regexp_extract(p, '(\S+)\.$', 1)), '^[^\p{L}\p{N}]+', ''), '') END"""
    return rf"""
sw AS (SELECT {word.format(x='w')} AS w FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS w FROM {docs})),
sc AS (SELECT regexp_replace(w, '\.$', '') AS word, count(*) FILTER (ends_with(w, '.')) AS cw, count(*) FILTER (NOT ends_with(w, '.')) AS co FROM sw WHERE regexp_matches(w, '\p{{L}}') GROUP BY 1),
st AS (SELECT sum(cw + co) AS n, sum(cw) AS dots FROM sc),
sl AS (SELECT word, cw, co, n, dots, length(word) - length(replace(word, '.', '')) + 1 AS pd FROM sc, st WHERE cw > 0 AND dots < n),
abbr AS (
  SELECT word FROM (
    SELECT word, -2 * ((cw * ln(dots / n) + CASE WHEN co > 0 THEN co * ln(1 - dots / n) ELSE 0 END) - (cw * ln(0.99) + co * ln(0.01)))
           * exp(-(length(word) - pd + 1)) * pd * pow(CAST(length(word) - pd + 1 AS DOUBLE), -co) AS score FROM sl) WHERE score >= 0.3
),
sp AS (SELECT id, string_split(regexp_replace(text, '([.!?]["'')\]]*)\s+', '\1' || chr(1), 'g'), chr(1)) AS ps FROM {docs}),
sx AS (SELECT id, i, p, {last} AS lw FROM (SELECT id, unnest(range(len(ps))) AS i, unnest(ps) AS p FROM sp)),
sj AS (SELECT id, string_agg(p || CASE WHEN lw IN (SELECT word FROM abbr) THEN ' ' ELSE chr(2) END, '' ORDER BY i) AS t FROM sx GROUP BY id),
sents AS (SELECT id, list_filter(list_transform(string_split(t, chr(2)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s FROM sj)"""
