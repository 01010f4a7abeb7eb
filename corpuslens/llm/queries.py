"""Registered queries of the training-data operators, with their DuckDB twins.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversation_repair, decontaminate, language_id, license_scan, quality_pu, secret_scan, simhash_dedup, source_mixing,
               suffix_dedup, token_counts, topk_search, vector_codes, warc)
from .common import id_fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op4_simhash_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"), shingle_words=3, max_distance=2)


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    own = F.filter("spans", lambda s: s["layer"] == "")
    count = lambda kind: F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in secret_scan.KINDS], F.sha2(text(own), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"), "n_oversize")


@query("op7_source_mixing", sql=r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM d GROUP BY source
), w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][kind + 1] AS weight FROM s
), r AS (
  SELECT *, sum(2.0 * source_size) OVER o - 2.0 * source_size AS held_before, sum(weight) OVER () - sum(weight) OVER o + weight AS open_weight,
         1.5 * sum(source_size) OVER () AS share, 2.0 * source_size / weight AS stop
  FROM w WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), rate AS (SELECT max((share - held_before) / open_weight) AS x FROM r WHERE (share - held_before) / open_weight <= stop
), t AS (SELECT source, source_size, kind, least(2.0 * source_size, (SELECT x FROM rate) * weight) AS target FROM r
), p AS (
  SELECT d.*, t.source_size, t.kind, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(least(goal - start, size), 0) AS one, greatest(least(goal - start - source_size, size), 0) AS two FROM p
), u AS (SELECT *, (start + one / 2) / greatest(target, 1) AS u1, (start + source_size + two / 2) / greatest(target, 1) AS u2 FROM k)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, CAST(one + two AS BIGINT) AS taken,
  CASE WHEN one > 0 THEN round(CASE kind WHEN 0 THEN 6 * u1 / (4.5 + sqrt(20.25 - 18 * u1)) WHEN 1 THEN u1 ELSE 4 * u1 / (1 + sqrt(1 + 8 * u1)) END, 6) END AS position,
  CASE WHEN two > 0 THEN round(CASE kind WHEN 0 THEN 6 * u2 / (4.5 + sqrt(20.25 - 18 * u2)) WHEN 1 THEN u2 ELSE 4 * u2 / (1 + sqrt(1 + 8 * u2)) END, 6) END AS second_position
FROM u
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"))
    at = lambda k: F.round(F.get("passes", F.lit(k))["position"], 6)
    return mixed.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken",
                        at(0).alias("position"), at(1).alias("second_position"))


@query("op8_topk_search", sql="""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op3_warc", sql="""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    own = F.col("record_type") == "response"  # its figures come from the payload read back, a revisit's from its header
    return back.select(F.col("record_id").alias("page_id"), F.when(own, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                       F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False))
    found = language_id.identify(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


@query("op9_quality_pu")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality_pu.featurise(table(spark, sf_dir, "documents"))
    held_out = F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False))
    training = F.col("doc_id").isNotNull() & ~held_out
    scored = quality_pu.score(features, quality_pu.fit(features, table(spark, sf_dir, "labels"), training))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_decontaminate")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _tree(docs: DataFrame) -> DataFrame:
    """``documents`` as a file tree: source/lang/block of 64 ids. A document that
    opens with a licence notice plays the directory's licence file; by its id it
    stands in the block, language or source directory. The file's name holds id
    and text hash, so that null and repeated ids are files of their own."""
    top, mid = F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none"))
    opens = F.lower(F.substring_index("text", "\n", 1)).contains("licen")
    block = F.floor(F.col("doc_id") / 64).cast("string")
    place = F.when(opens & (F.col("doc_id") % 7 == 0), top).when(opens & (F.col("doc_id") % 3 == 0), F.concat_ws("/", top, mid)).otherwise(F.concat_ws("/", top, mid, block))
    own = F.concat_ws("-", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text")))
    name = F.when(opens, F.concat(F.lit("LICENSE-"), own)).otherwise(F.concat(own, F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", place, name).alias("path"), "text")


_NOTICES = ", ".join("('{}', '{}')".format(*t) for t in license_scan.TEMPLATES)


@query("op1_license_scan", sql=r"""
WITH tpl(license_id, text) AS (VALUES """ + _NOTICES + r"""),
tt AS (SELECT license_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+(?:\.\p{N}+)*')) AS token FROM tpl),
tc AS (SELECT license_id, token, count(*) AS tf FROM tt GROUP BY ALL),
idf AS (SELECT token, ln((1 + (SELECT count(*) FROM tpl)) / (1.0 + count(*))) + 1 AS idf FROM tc GROUP BY token),
tw AS (SELECT license_id, token, tf * idf AS x FROM tc JOIN idf USING (token)),
tn AS (SELECT license_id, sqrt(sum(x * x)) AS norm FROM tw GROUP BY 1),
w AS (SELECT license_id, token, x / norm AS w FROM tw JOIN tn USING (license_id)),
d AS (
  SELECT doc_id, text, coalesce(source, 'none') AS top, coalesce(lang, 'none') AS mid, contains(lower(split_part(text, chr(10), 1)), 'licen') AS opens FROM documents
), f AS (
  SELECT doc_id, text, CASE WHEN opens AND doc_id % 7 = 0 THEN top WHEN opens AND doc_id % 3 = 0 THEN top || '/' || mid
                            ELSE top || '/' || mid || '/' || CAST(doc_id // 64 AS VARCHAR) END AS dir, coalesce(opens, false) AS opens FROM d
), u AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM f UNION SELECT doc_id, text FROM f WHERE opens
), ud AS (SELECT DISTINCT unit FROM u),
ut AS (SELECT unit, unnest(regexp_extract_all(lower(unit), '[\p{L}\p{N}]+(?:\.\p{N}+)*')) AS token FROM ud),
uc AS (SELECT unit, token, count(*) AS tf FROM ut GROUP BY ALL),
ux AS (SELECT unit, token, tf * coalesce(idf, ln(1 + (SELECT count(*) FROM tpl)) + 1) AS x FROM uc LEFT JOIN idf USING (token)),
un AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM ux GROUP BY 1),
us AS (SELECT unit, license_id, round(sum(x * w) / any_value(norm), 6) AS score FROM ux JOIN w USING (token) JOIN un USING (unit) GROUP BY 1, 2),
own AS (
  SELECT doc_id, license_id, score FROM (
    SELECT doc_id, license_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license_id) AS r FROM u JOIN us USING (unit) WHERE score >= 0.7
  ) WHERE r = 1
), dl AS (
  SELECT dir, license_id, score FROM (
    SELECT dir, license_id, score, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license_id) AS r FROM f JOIN own USING (doc_id) WHERE opens
  ) WHERE r = 1
), inh AS (
  SELECT doc_id, dl.dir AS up, dl.license_id AS dir_license, dl.score AS dir_score, row_number() OVER (PARTITION BY doc_id ORDER BY length(dl.dir) DESC) AS r
  FROM f JOIN dl ON f.dir = dl.dir OR starts_with(f.dir, dl.dir || '/')
)
SELECT f.doc_id, coalesce(own.license_id, dir_license) AS license_id, coalesce(own.score, dir_score) AS score,
       CASE WHEN own.license_id IS NOT NULL THEN 'header' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
       CASE WHEN own.license_id IS NULL THEN up END AS licensed_by
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN (SELECT * FROM inh WHERE r = 1) i USING (doc_id)
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_tree(table(spark, sf_dir, "documents")), license_scan.templates(spark), texts=license_scan.texts(spark), keep=("doc_id",))
    return found.select("doc_id", "license_id", "score", "how", "licensed_by")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.section_tokens(table(spark, sf_dir, "documents"), rule="most")
    return counted.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing", "doc_tokens")


@query("op11_suffix_dedup", sql="""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
p AS (  -- overlapping pieces, so that no window is cut out of a very long string
  SELECT doc_id, b, substr(h, 2000 * b + 1, 2198) AS piece FROM (SELECT doc_id, h, unnest(range((length(h) + 1999) // 2000)) AS b FROM d)
), w AS (
  SELECT doc_id, 1000 * b + k AS place, md5(substr(piece, 2 * k + 1, 200)) AS str FROM (SELECT *, unnest(range(1000)) AS k FROM p) WHERE length(piece) >= 2 * k + 200
), f AS (SELECT str, min({'doc': doc_id, 'place': place}) AS first FROM w GROUP BY str),
r AS (SELECT doc_id, place FROM w JOIN f USING (str) WHERE first.doc <> doc_id OR first.place <> place),
g AS (SELECT doc_id, place, CASE WHEN place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 100 OR lag(place) OVER (PARTITION BY doc_id ORDER BY place) IS NULL THEN 1 ELSE 0 END AS opens FROM r),
i AS (SELECT doc_id, place, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS span FROM g),
s AS (SELECT doc_id, span, min(place) AS start, max(place) + 100 AS stop FROM i GROUP BY doc_id, span),
t AS (
  SELECT doc_id, count(*) AS n_spans, sum(stop - start) AS n_removed, list(start ORDER BY start) AS starts, list(stop ORDER BY start) AS stops FROM s GROUP BY doc_id
), k AS (
  SELECT doc_id, h, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         list_prepend(0, coalesce(stops, [])) AS lo, list_append(coalesce(starts, []), length(h) // 2) AS hi FROM d LEFT JOIN t USING (doc_id)
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(array_to_string(list_transform(list_zip(lo, hi), lambda z: substr(h, 2 * z[1] + 1, 2 * (z[2] - z[1]))), ''), ''))) AS kept_sha256
FROM k
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), min_bytes=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _codes_sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """Rounds of brute-force assignment and integer means, one CTE each."""
    nearest = """SELECT r, part, min({{'d': d, 'entry': entry}}) AS best FROM (
      SELECT s.r, s.part, b.entry, CAST(list_sum(list_transform(list_zip(s.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
      FROM s JOIN b{k} b ON s.part = b.part) GROUP BY r, part"""
    sql = f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), n AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS r, len(v) // {parts} AS width FROM e),
s AS MATERIALIZED (SELECT r, part, v[part * width + 1:(part + 1) * width] AS v FROM n, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, r AS entry, v AS c FROM s WHERE r < {entries})"""
    for k in range(rounds):
        sql += f""",
a{k} AS MATERIALIZED ({nearest.format(k=k)}),
m{k} AS (SELECT s.part, best.entry AS entry, unnest(range(len(v))) AS place, unnest(v) AS x FROM s JOIN a{k} a ON s.r = a.r AND s.part = a.part),
u{k} AS (SELECT part, entry, list(c ORDER BY place) AS c FROM (SELECT part, entry, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS c FROM m{k} GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(u.c, b.c) AS c FROM b{k} b LEFT JOIN u{k} u ON b.part = u.part AND b.entry = u.entry)"""
    return sql + f""",
z AS ({nearest.format(k=rounds)}),
c AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM z GROUP BY r),
h AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry), '')) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM n JOIN c USING (r), h
"""


@query("op12_vector_codes", sql=_codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.fingerprint(books)).alias("codebooks_sha256"))


@query("op13_conversation_repair", sql=r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), o AS (
  SELECT conv_id AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS bytes
  FROM conversations
), f AS (SELECT *, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS fault FROM o, crc),
g AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM f WHERE fault <> 0
), h AS (
  SELECT *, row_number() OVER c AS i, row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, copy) AS seen, lag(role[1]) OVER c AS before
  FROM g WINDOW c AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), r AS MATERIALIZED (
  SELECT conv, turn, role, text, i, before, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault FROM h
), ins(q, to_q) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
keep(initial, q, to_q) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ahead(q, place, cost, audit) AS (
  SELECT q, q, 0, '' FROM ins UNION ALL SELECT q, to_q, 3, 'I' FROM ins UNION ALL SELECT a.q, b.to_q, 6, 'II' FROM ins a JOIN ins b ON a.to_q = b.q
), walk AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM r
  UNION ALL
  SELECT conv, i, q, best.cost, best.audit, best.said FROM (
    SELECT w.conv, r.i, s.to_q AS q, min({'cost': w.cost + l.cost + s.cost + CASE WHEN s.letter <> 'D' AND r.fault = 't' THEN 3 ELSE 0 END, 'audit': w.audit || l.audit || s.letter,
      'said': w.said || CASE length(l.audit) WHEN 0 THEN '' WHEN 1 THEN CASE WHEN w.q = 2 THEN 'assistant:' ELSE 'user:' END || chr(10)
                        ELSE CASE WHEN w.q = 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10) END
              || CASE s.letter WHEN 'D' THEN '' WHEN 'K' THEN r.role || ':' || r.text || chr(10) ELSE CASE s.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text || chr(10) END}) AS best
    FROM walk w JOIN r ON w.conv IS NOT DISTINCT FROM r.conv AND r.i = w.i + 1 JOIN ahead l ON l.q = w.q
    JOIN (SELECT '' AS initial, q, q AS to_q, 4 AS cost, 'D' AS letter FROM ins UNION ALL SELECT '', q, to_q, 3, 'R' FROM ins UNION ALL SELECT initial, q, to_q, 0, 'K' FROM keep) s
      ON s.q = l.place AND (s.letter = 'D' OR r.fault NOT IN ('b', 'd')) AND (s.letter <> 'K' OR s.initial = r.role[1])
    GROUP BY w.conv, r.i, s.to_q
  )
), walked AS (SELECT w.* FROM walk w JOIN (SELECT conv, max(i) AS n FROM r GROUP BY conv) m ON w.conv IS NOT DISTINCT FROM m.conv AND w.i = m.n),
ended AS (
  SELECT conv, min({'cost': cost + CASE q WHEN 1 THEN 6 WHEN 2 THEN 3 ELSE 0 END, 'audit': audit || CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'said': said || CASE q WHEN 1 THEN 'user:' || chr(10) || 'assistant:' || chr(10) WHEN 2 THEN 'assistant:' || chr(10) ELSE '' END}) AS best FROM walked GROUP BY conv
), counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(regexp_replace(best.said, '\n\z', ''), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON a.conv_id IS NOT DISTINCT FROM c.conv LEFT JOIN ended e ON a.conv_id IS NOT DISTINCT FROM e.conv
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversation_repair.rows_of(table(spark, sf_dir, "conversations"))
    damaged = conversation_repair.damage(rows)
    found = conversation_repair.summary(conversation_repair.repair(damaged), damaged).withColumnRenamed("conv", "of")
    every = rows.select("conv").distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    columns = [F.coalesce(F.col(c), empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "of"]
    return every.join(found, every["conv"].eqNullSafe(found["of"]), "left").select(F.col("conv").alias("conv_id"), *columns)
