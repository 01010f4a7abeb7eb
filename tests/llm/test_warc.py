import hashlib

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import queries as Q
from corpuslens.llm import warc as W

LONG = "<p>é payload</p>" * 20
ROWS = [(5, "http://a/5", LONG), (3, "http://a/3?q=é x\r\ny", LONG), (9, None, LONG), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
        (7, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (8, "u", "x" * 300_000), (8, "u", "x" * 300_000), (None, "u", LONG), (10, "u", "y" * 99), (11, "u", "y" * 99)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit("x"))


def want(rows):
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        first = min(same) if len(b) >= 100 and same else None
        again = first is not None and i != first
        out.append((i, u, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None, None if again else b))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.record_id, r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in df.collect()), key=str)


def test_round_trip_is_exact(spark):
    assert got(W.round_trip(pages(spark))) == want(ROWS)
    assert W.round_trip(pages(spark, [])).count() == 0


def test_rolling_and_partition_plan(spark, tmp_path):
    path = str(tmp_path / "w")
    W.register(spark)
    W.to_records(pages(spark)).write.format("warc").option("maxFileBytes", 500).mode("append").save(path)
    assert len(list((tmp_path / "w").glob("*.warc"))) > 3 and not list((tmp_path / "w" / "_temporary").glob("*"))
    assert got(spark.read.format("warc").option("partitionBytes", 600).load(path)) == want(ROWS)
    assert len(W.WarcReader({"path": path, "partitionBytes": "600"}).partitions()) > 2


@pytest.mark.parametrize("where", ["record_type = 'revisit'", "record_type <> 'response'", "payload_bytes > 100 and record_id in (8, 3)", "refers_to is null", "record_id is null",
                                   "payload_digest = 'x'", "record_id <=> 5", "length(payload) > 10 and record_type = 'response'", "not (record_id in (1, 2))"])
def test_pushed_predicates(spark, tmp_path, where):
    path = str(tmp_path / "w")
    W.write_archives(W.to_records(pages(spark)), path)
    all_rows = spark.createDataFrame(W.read_archives(spark, path).collect(), W.SCHEMA)
    assert got(W.read_archives(spark, path).filter(where)) == got(all_rows.filter(where))


def test_unwanted_payloads_are_not_decoded(tmp_path, monkeypatch):
    rows = [dict(record_id=i, record_type="response", target_uri="u", payload_digest="d", payload_bytes=5, refers_to=None, payload=b"hello") for i in range(5)]
    path = tmp_path / "a.warc"
    path.write_bytes(b"".join(map(W.record, rows)))
    decoded = []
    inner = W._payload
    monkeypatch.setattr(W, "_payload", lambda b: decoded.append(1) or inner(b))
    with path.open("rb") as f:
        assert [r["payload"] for r in W.records(f, lambda r: r["record_id"] == 3, True)] == [b"hello"]
    assert len(decoded) == 1
    with path.open("rb") as f:
        assert len(list(W.records(f, lambda r: True, False))) == 5
    assert len(decoded) == 1


def test_lost_task_leaves_no_archive(spark, tmp_path):
    path = str(tmp_path / "w")
    bad = W.to_records(pages(spark)).withColumn("record_type", F.expr("case when record_id = 7 then raise_error('lost') else record_type end"))
    with pytest.raises(Exception):
        W.write_archives(bad, path)
    assert not list(tmp_path.glob("w/*.warc"))


def test_query_on_table(spark, sf):
    rows = [(r.page_id, None, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    out = Q.QUERIES["op3_warc"](spark, sf).collect()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == sorted((i, n, d, t, f) for i, _, n, d, t, f, _ in want(rows))


def _foreign(kind, uid, block, *extra, content="application/http; msgtype=response"):
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uid}>", "WARC-Target-URI: http://x/y", f"Content-Type: {content}", f"Content-Length: {len(block)}", *extra]
    return b"WARC/1.0\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_makers(spark, tmp_path):
    import gzip
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n7;x=1\r\n, world\r\n0\r\n\r\n"
    packed = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"zipped")
    broken = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\nnot gzip"
    records = [_foreign("warcinfo", "0", b"software: x\r\n", content="application/warc-fields"), _foreign("response", "1", b"no header at all"),
               _foreign("response", "2", chunked, "WARC-Payload-Digest: sha1:ABC", "X-Long: a", " folded: still the value"), _foreign("request", "3", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"),
               _foreign("resource", "4", b"<p>file</p>", content="text/html"), _foreign("response", "5", packed), _foreign("response", "6", broken),
               _foreign("revisit", "7", b"HTTP/1.1 200 OK\r\n\r\n", "WARC-Refers-To: <urn:uuid:2>"), _foreign("response", "8", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\nzz no chunks")]
    want = {"0": b"software: x\r\n", "1": b"no header at all", "2": b"hello, world", "3": b"", "4": b"<p>file</p>", "5": b"zipped", "6": b"not gzip", "7": None, "8": b"zz no chunks"}
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    rows = W.read_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 2 * len(records)
    for r in rows:
        uid = r["record_uri"].rsplit(":", 1)[1]
        assert (None if r["payload"] is None else bytes(r["payload"])) == want[uid] and r["record_id"] is None
        assert r["refers_to_uri"] == ("urn:uuid:2" if uid == "7" else None)
        assert (r["digest_algorithm"], r["payload_digest"]) == (("sha1", "ABC") if uid == "2" else (None, None))
    some = W.read_archives(spark, str(tmp_path)).filter("record_type = 'resource'")
    assert [bytes(r["payload"]) for r in some.collect()] == [b"<p>file</p>"] * 2
