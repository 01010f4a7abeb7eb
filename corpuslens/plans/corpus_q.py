"""Dictionary entities (E1), estimated Jaccard (A11, J9) and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gazetteer as G
from ..operators import similarity as S
from ..operators import topics as TP
from ..operators.models import TOPIC_STOPWORDS
from . import roles
from .catalog import REF, SYN, register, ws

_W = "string_split(text, ' ')"
_LONG = f"list_reduce({_W}, lambda a, x: CASE WHEN length(x) > length(a) OR (length(x) = length(a) AND x < a) THEN x ELSE a END)"
_TOKENS = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"

#: Names of one to six words, with names inside and across them.
NAMES = f"""
w AS (SELECT item_id, {_W} AS w, greatest(least(list_position({_W}, {_LONG}), len({_W}) - 6), 1) AS place FROM benchmark),
names AS (
  SELECT array_to_string(list_slice(w, place, place + item_id % 6), ' ') AS entity, 'whole' AS label FROM w
  UNION ALL SELECT array_to_string(list_slice(w, place + 1, place + 1 + (item_id * 7) % 5), ' '), 'inner' FROM w
  UNION ALL SELECT array_to_string(list_slice(w, place, place + 1), ' '), 'head' FROM w
)"""


@register("entity_gazetteer", f"""
WITH RECURSIVE {NAMES},
d AS (SELECT t, min({{'entity': entity, 'label': label}}) AS e FROM (SELECT {_TOKENS.format(x='entity')} AS t, entity, label FROM names) WHERE len(t) > 0 GROUP BY t),
k AS (SELECT doc_id, {_TOKENS.format(x='text')} AS t FROM documents),
p AS (SELECT doc_id, t, unnest(range(len(t))) AS pos FROM k),
hit AS (SELECT p.doc_id, pos, max({{'n': len(d.t), 'e': e}}) AS best FROM p JOIN d ON p.t[pos + 1] = d.t[1] AND list_slice(p.t, pos + 1, pos + len(d.t)) = d.t GROUP BY ALL),
m AS MATERIALIZED (SELECT doc_id, pos, best.n AS n, best.e AS e FROM hit),
walk AS (
  SELECT doc_id, min(pos) AS pos FROM m GROUP BY doc_id
  UNION ALL
  SELECT w.doc_id, min(nx.pos) FROM walk w JOIN m c ON w.doc_id = c.doc_id AND w.pos = c.pos JOIN m nx ON nx.doc_id = c.doc_id AND nx.pos >= c.pos + c.n GROUP BY w.doc_id
)
SELECT doc_id, pos, CAST(n AS BIGINT) AS n_tokens, e.entity AS entity, e.label AS label FROM walk JOIN m USING (doc_id, pos)""")
def entity_gazetteer(spark, sf):
    return G.gazetteer_entities(roles.documents(spark, sf), roles.gazetteer(spark, sf))


_HASHES = 64


def _minhash_sql() -> str:
    a, b = S.minhash_constants(_HASHES)
    sets = f"""SELECT '{{side}}' AS side, list_transform(list_distinct({ws('text')}), lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % {S.MINHASH_PRIME}) AS x FROM {{docs}}"""
    return f"""
WITH s AS ({sets.format(side='a', docs=SYN)} UNION ALL {sets.format(side='b', docs=REF)}),
f AS (SELECT unnest(range({_HASHES})) AS f, unnest({a}) AS a, unnest({b}) AS b),
v AS (SELECT side, f, list_min(list_transform(x, lambda y: (a * y + b) % {S.MINHASH_PRIME})) AS v FROM s, f WHERE len(x) > 0),
c AS (SELECT f, v, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM v GROUP BY f, v),
n AS (SELECT count(*) FILTER (side = 'a') AS n1, count(*) FILTER (side = 'b') AS n2, count(*) FILTER (side = 'a' AND len(x) = 0) AS e1, count(*) FILTER (side = 'b' AND len(x) = 0) AS e2 FROM s)
SELECT round((SELECT sum(na * nb) FROM c) / {_HASHES}.0 / (n1 * n2 - e1 * e2), 6) AS jaccard FROM n"""


@register("jaccard_minhash", _minhash_sql())
def jaccard_minhash(spark, sf):
    return S.jaccard_minhash(roles.syn_docs(spark, sf), roles.ref_docs(spark, sf), n_hashes=_HASHES)


# -- topics -----------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in TOPIC_STOPWORDS)
_K, _PASSES = 3, 10


def _psi(x: str) -> str:
    y = f"({x} + 6)"
    shift = " + ".join(f"1.0 / ({x} + {i})" for i in range(6))
    inv = f"(1.0 / ({y} * {y}))"
    return f"(ln({y}) - 0.5 / {y} - {inv} * ({1 / 12} - {inv} * ({1 / 120} - {inv} * {1 / 252})) - ({shift}))"


def _topics_sql() -> str:
    """Ten passes, each half a CTE: mixtures m, words l."""
    each = lambda form: ", ".join(form.format(t=t) for t in range(_K))
    total = lambda form: " + ".join(form.format(t=t) for t in range(_K))
    sql = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]|_|\d', ' ', 'g'), '\s+')) AS term FROM {SYN}
), c AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM raw WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY ALL),
l0 AS MATERIALIZED (SELECT term, {each("1 + CAST('0x' || substr(md5('7:' || term || ':{t}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS l{t}")} FROM (SELECT DISTINCT term FROM c)),
m0 AS MATERIALIZED (SELECT doc_id, {each(f"1.0::DOUBLE / {_K} + sum(tf) / {_K}::DOUBLE AS g{{t}}")} FROM c GROUP BY doc_id)"""
    for n in range(_PASSES):
        beta = f"""b{n} AS MATERIALIZED (SELECT term, {each("exp(" + _psi("l{t}") + " - " + _psi("s{t}") + ") AS b{t}")} FROM l{n}, (SELECT {each("sum(l{t}) AS s{t}")} FROM l{n}))"""
        norm = total("h{t} * b{t}")
        for half, (key, prior, name, old) in enumerate((("doc_id", f"1.0::DOUBLE / {_K}", "g", f"m{n}"), ("term", f"1.0::DOUBLE / {_K}", "l", f"m{n + 1}"))):
            theta = f"""h{n}{half} AS MATERIALIZED (SELECT doc_id, {each("exp(" + _psi("g{t}") + " - " + _psi("gs") + ") AS h{t}")} FROM (SELECT *, {total("g{t}")} AS gs FROM {old}))"""
            into = f"m{n + 1}" if half == 0 else f"l{n + 1}"
            sums = ", ".join(f"{prior} + sum(tf * h{t} * b{t} / ({norm})) AS {name}{t}" for t in range(_K))
            sql += (f",\n{beta}" if half == 0 else "") + f",\n{theta},\n{into} AS MATERIALIZED (SELECT {key}, {sums} FROM c JOIN h{n}{half} USING (doc_id) JOIN b{n} USING (term) GROUP BY {key})"
    ps = " UNION ALL ".join(f"SELECT {t} AS topic, term, l{t} / (SELECT sum(l{t}) FROM l{_PASSES}) AS weight FROM l{_PASSES}" for t in range(_K))
    return sql + f""",
ranked AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank, term, weight FROM ({ps}))"""


@register("topics_lda", _topics_sql() + "\nSELECT CAST(topic AS BIGINT) AS topic, rank, term, round(weight, 6) AS weight FROM ranked WHERE rank <= 5")
def topics_lda(spark, sf):
    return TP.top_terms(TP.fit_topics(roles.syn_docs(spark, sf), k=_K, passes=_PASSES), 5)


@register("topic_explorer", _topics_sql() + f""",
tf AS (SELECT term, sum(tf) AS tf FROM c GROUP BY term),
share AS (
  SELECT {", ".join(f"avg(g{t} / ({' + '.join(f'g{j}' for j in range(_K))})) AS p{t}" for t in range(_K))} FROM m{_PASSES}
)
SELECT CAST(topic AS BIGINT) AS topic, term, round(weight, 6) AS p_term_topic, round(tf / (SELECT sum(tf) FROM c), 6) AS p_term,
       round(0.6 * ln(weight) + 0.4 * ln(weight / (tf / (SELECT sum(tf) FROM c))), 6) AS relevance,
       round(CASE topic {" ".join(f"WHEN {t} THEN p{t}" for t in range(_K))} END, 6) AS topic_share
FROM ranked JOIN tf USING (term), share WHERE rank <= 10""")
def topic_explorer(spark, sf):
    return TP.topic_explorer(TP.fit_topics(roles.syn_docs(spark, sf), k=_K, passes=_PASSES), top_n=10)
