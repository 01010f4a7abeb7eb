"""WARC archives as a PySpark Python data source, ``format("warc")``.

Writing: one archive per partition (rolled at ``maxFileBytes``), written under a
temporary name and renamed by the job's commit, so retried or lost tasks leave
no partial archive. A response's block is an HTTP message whose body is gzipped
(``Content-Encoding: gzip``); its record header stays plain text. A revisit has
an empty block and names the response it repeats.

Reading: the plan lists the archives and packs them into partitions of about
``partitionBytes``. A task reads record headers one after another; predicates on
``record_type``, ``target_uri``, ``record_id``, ``refers_to``, ``payload_digest``
and ``payload_bytes`` are pushed down and decided on the header alone. The block
of a record that fails them, or any block with ``payload=false``, is skipped by
a seek: neither read nor unzipped.

Paths are opened through pyarrow's file systems (local, hdfs://, s3://, gs://),
by executors and driver alike: the folder must be one they share.

Archives of other makers (``.warc`` and ``.warc.gz``): ids are kept as text in
``record_uri`` and ``refers_to_uri`` (``record_id`` is null unless it is a page's),
the digest's algorithm in ``digest_algorithm``; folded header lines are joined; the
payload of a block that is no HTTP message is the block, of an HTTP message its
body with chunks joined and gzip undone (left as it stands where that fails).

Defined results: a null payload is an empty payload; null uris and ids stay null
(the header is left out); repeated rows are separate records; an empty table
writes no archive and reads back as no rows; a very long payload is held whole by
the one task that reads or writes it.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
                                    WriterCommitMessage)

from ..session import scratch_path

SCHEMA = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
                       T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
                       T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()), T.StructField("record_uri", T.StringType()),
                       T.StructField("refers_to_uri", T.StringType()), T.StructField("digest_algorithm", T.StringType())])
HEADER_FIELDS = frozenset(SCHEMA.names) - {"payload"}
_ID = "urn:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = b"\r\n\r\n"


# -- record format ----------------------------------------------------------

def record(row: dict) -> bytes:
    """The bytes of one record; ``row`` has the fields of SCHEMA."""
    block, extra = b"", []
    if row["record_type"] == "revisit":
        extra = [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{_ID}{row['refers_to']}>")]
    else:
        body = gzip.compress(row["payload"] or b"", compresslevel=6, mtime=0)
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Encoding: gzip\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
    head = [("WARC-Type", row["record_type"]), ("WARC-Date", "1970-01-01T00:00:00Z")]
    head += [("WARC-Record-ID", f"<{_ID}{row['record_id']}>")] if row["record_id"] is not None else [("WARC-Record-ID", f"<{uuid.uuid4().urn}>")]
    head += [("WARC-Target-URI", quote(row["target_uri"], safe=":/?#[]@!$&'()*+,;=%~-._"))] if row["target_uri"] is not None else []
    head += [("WARC-Raw-Target", quote(row["target_uri"], safe=""))] if row["target_uri"] is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"), ("WARC-Payload-Length", str(row["payload_bytes"])), *extra,
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + _END


def _header(lines: list[bytes]) -> tuple[dict, int]:
    """The SCHEMA fields that a record header holds, and its block's length."""
    whole: list[bytes] = []
    for x in lines:
        if x[:1] in b" \t" and whole:  # a folded line goes on with the one before
            whole[-1] += b" " + x.strip()
        else:
            whole.append(x)
    h = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in whole)}
    bare = lambda v: v.removeprefix("<").removesuffix(">") if v else None
    page = lambda v: int(v[len(_ID) + 1:-1]) if v and v.startswith(f"<{_ID}") else None
    raw = h.get("warc-raw-target")
    digest, length = h.get("warc-payload-digest"), h.get("warc-payload-length")
    return {"record_id": page(h.get("warc-record-id")), "record_type": h.get("warc-type"), "target_uri": unquote(raw) if raw is not None else h.get("warc-target-uri"),
            "payload_digest": digest.rpartition(":")[2] if digest else None, "payload_bytes": int(length) if length else None,
            "refers_to": page(h.get("warc-refers-to")), "record_uri": bare(h.get("warc-record-id")), "refers_to_uri": bare(h.get("warc-refers-to")),
            "digest_algorithm": digest.partition(":")[0].lower() if digest and ":" in digest else None}, int(h["content-length"])


def _chunks(body: bytes) -> bytes:
    """A chunked body put together; as it stands if it is not one."""
    out, at = [], 0
    while True:
        line, end = body[at:at + 64], body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 and end - at < 64 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF") or not line:
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            return body
        out.append(body[end + 2:end + 2 + n])
        at = end + 2 + n + 2


def _payload(block: bytes) -> bytes:
    """The body of an HTTP message, with chunks joined and gzip undone; any other block whole."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or b"HTTP/" not in head.partition(b"\r\n")[0]:
        return block
    fields = head.lower()
    if b"transfer-encoding: chunked" in fields:
        body = _chunks(body)
    if b"content-encoding: gzip" in fields:
        try:
            return gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            return body
    return body


def records(stream, wanted, payload: bool) -> Iterator[dict]:
    """Records of an open archive whose header satisfies ``wanted``."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(version)}: {version[:40]!r}")
        lines = []
        while (line := stream.readline().rstrip(b"\r\n")):
            lines.append(line)
        row, length = _header(lines)
        if not wanted(row):
            stream.seek(length + len(_END), 1)
            continue
        if payload and row["record_type"] != "revisit":
            row["payload"] = _payload(stream.read(length))
            stream.seek(len(_END), 1)
        else:
            row["payload"] = None
            stream.seek(length + len(_END), 1)
        yield row


# -- predicates -------------------------------------------------------------

def _decides(f: Filter) -> bool:
    if isinstance(f, Not):
        return _decides(f.child) and not isinstance(f.child, Not)
    return isinstance(f, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_FIELDS


def _truth(f: Filter, row: dict) -> bool | None:
    """SQL's three-valued truth of a pushed filter for a record header."""
    if isinstance(f, Not):
        inner = _truth(f.child, row)
        return None if inner is None else not inner
    v = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, IsNotNull):
        return v is not None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None or not isinstance(f, In) and f.value is None:
        return None
    if isinstance(f, In):
        return True if v in f.value else None if None in f.value else False
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, GreaterThan):
        return v > f.value
    if isinstance(f, GreaterThanOrEqual):
        return v >= f.value
    return v < f.value if isinstance(f, LessThan) else v <= f.value


# -- data source ------------------------------------------------------------

def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Archives(InputPartition):
    files: tuple[str, ...] = ()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.filters = options["path"], []
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _decides(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Archives]:
        system, root = _open(self.path)
        if system.get_file_info(root).type == pafs.FileType.NotFound:
            return []
        found = sorted((i.path, i.size) for i in system.get_file_info(pafs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith((".warc", ".warc.gz")) and "/_temporary" not in i.path)
        out, held, size = [], [], 0
        for path, n in found:
            if held and size + n > self.most:
                out.append(Archives(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Archives(tuple(held))] if held else out

    def read(self, partition: Archives | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no archives
            return
        system, _ = _open(self.path)
        kinds = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.typeName()]) for n, f in zip(SCHEMA.names, SCHEMA.fields)])
        wanted = lambda row: all(_truth(f, row) for f in self.filters)
        held, size = [], 0
        for path in partition.files:
            with _stream(system, path) as stream:
                for row in records(stream, wanted, self.payload):
                    held.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, kinds)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)


def _stream(system: pafs.FileSystem, path: str) -> io.BufferedIOBase:
    """An archive's bytes; a gzipped one (a member for each record) is unzipped as it
    is read, and skipping a block there unzips it without keeping it."""
    raw = io.BufferedReader(_Raw(system.open_input_file(path)), 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if path.endswith(".gz") else raw


class _Raw(io.RawIOBase):
    """A pyarrow file as a raw stream: a buffered reader over it skips blocks
    that lie beyond its buffer without reading them."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.file.seek(offset, whence)

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...] = ()


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.most = int(options.get("maxfilebytes", options.get("maxFileBytes", 256 << 20)))
        self.job = uuid.uuid4().hex
        if overwrite:
            raise ValueError("write archives to a new folder in append mode")

    def write(self, rows: Iterator) -> Written:
        system, root = _open(self.path)
        files: list[str] = []
        out, size = None, 0
        try:
            for row in rows:
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                    system.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
                    files.append(f"{uuid.uuid4().hex}.warc")
                    out, size = system.open_output_stream(f"{root}/_temporary/{self.job}/{files[-1]}"), 0
                data = record(row.asDict())
                out.write(data)
                size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _open(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                system.move(f"{root}/_temporary/{self.job}/{f}", f"{root}/{f}")
        self._clear(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, system: pafs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_temporary/{self.job}").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary/{self.job}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages to archives and back ---------------------------------------------

def to_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """Rows of SCHEMA. Of equal payloads of at least ``least_bytes`` bytes the
    smallest id is the response (all rows of that id are), others revisit it.
    The digests of repeated payloads alone are joined back, after a partial
    aggregate, so a payload that fills a third of all rows is one row there."""
    c = lambda n: F.col(f"`{n}`")
    payload = F.encode(F.coalesce(c(html_col), F.lit("")), "UTF-8")
    named = pages.select(c(id_col).cast("long").alias("record_id"), c(uri_col).cast("string").alias("target_uri"), payload.alias("payload"))
    named = named.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    firsts = (named.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
              .agg(F.min("record_id").alias("first"), F.max("record_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "first"))
    joined = named.join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    return joined.select("record_id", F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest", "payload_bytes",
                         F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"))


def write_archives(rows: DataFrame, path: str) -> None:
    register(rows.sparkSession)
    given = [F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMA.fields]
    rows.select(*given).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """The records of all pages, read back from archives in the shared scratch folder."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(to_records(pages), path)
    return read_archives(spark, path)
