"""Secret scan with a recursive decoding worklist.

Every text is a layer of its own. A layer is scanned for secrets, then each
encoding found in it gives further layers: percent escapes, Unicode escapes and
character references, base64 runs, and compressed bytes (gzip, zlib, bzip2, xz,
zstandard). The worklist runs until no new layer appears; a layer whose content
was already seen for the same place of the text is not taken up again, so
self-reproducing archives end. Every layer keeps, for each of its characters,
which code points of the original text it came from; findings of any depth are
reported as spans of the original text.

The scan is row-local (one map stage over Arrow batches, no shuffle). Memory is
bounded by one text, its layers and ``max_layer_chars``; time follows what is
inflated. A compressed layer that inflates beyond ``max_layer_chars`` is read to
its end in windows of that size; a window starts where the runs and streams that
the last one left open begin, so what lies across a cut is met whole. Members
and frames that follow one another are one layer. ``n_oversize`` counts the
layers read in windows and those that a decoder refuses (a dictionary or window
over its memory limit). ``redact`` masks the whole region of a refused layer, and
of one with an open run longer than half a window, which cannot be carried over.

Defined results: a null or empty text has no spans; repeated rows repeat their
result; null ids pass through; an empty table gives no rows; other columns are
ignored by ``scan`` and kept as they are by ``redact``.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, strings, type_of

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex")
_KEYS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_OPEN_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*(?:[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]*)?\Z", re.I | re.A)
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs of any length kept from 24 on

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
#: Lines may be folded at line ends or at their JSON escapes; the last one has any length.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/_-]{16,}={0,2})*(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/_-]+={0,2})?")
_BASE64_LINE = re.compile(r"((?:\\r)?\\n)?([A-Za-z0-9+/_-]+)(={0,2})")
_MAGIC = re.compile(r"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_BYTES = re.compile(r"[\x00-\xff]+")

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                  T.StructField("end", T.IntegerType()), T.StructField("layer", T.StringType())]))


@dataclass
class Layer:
    """A decoded text; ``starts``/``ends`` give each character's place in the
    original (None: the text itself; one pair for all: a compressed region)."""
    text: str
    path: str
    starts: np.ndarray | int | None = None
    ends: np.ndarray | int | None = None
    carried: int | None = None  # of a window: from where the next one repeats it

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def derived(self, text: str, name: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer whose character i came from this layer's [starts[i], ends[i])."""
        if isinstance(self.starts, int):
            starts, ends = self.starts, self.ends
        elif self.starts is not None:
            starts, ends = self.starts[starts], self.ends[ends - 1]
        return Layer(text, f"{self.path}>{name}" if self.path else name, starts, ends)


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """Base findings ``(start, kind index, end)``, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


class Stream:
    """Compressed bytes ``text[start:stop]`` (a character per byte), read member
    by member. After a pass of ``chunks``, ``used`` is where the last whole member
    ends, and ``end`` says how it ended: whole, cut (the bytes ran out), broken or
    refused (over the memory limit)."""

    def __init__(self, text: str, start: int, stop: int):
        self.text, self.start, self.stop = text, start, stop
        self.used, self.end, self.whole = start, "", True
        self.path, self.place = "", (0, 0)

    def _member(self, step: int) -> Iterator[bytes]:
        at, head = self.used, self.text[self.used:self.used + 6]
        zlibs, zstd = head[0] in "\x1f\x78", head[0] == "\x28"
        if zlibs:
            d = zlib.decompressobj(31 if head[0] == "\x1f" else 15)
        elif zstd:
            d = zstandard.ZstdDecompressor(max_window_size=1 << 27).decompressobj()
        else:
            d = bz2.BZ2Decompressor() if head[0] == "B" else lzma.LZMADecompressor(memlimit=256 << 20)
        feed = 256 if zstd else 1 << 14  # zstandard has no limit on what a call returns: 128 KB for 4 bytes at most
        rest = b""
        while not d.eof:
            if not rest and (zlibs or zstd or d.needs_input):
                rest = self.text[at:min(at + feed, self.stop)].encode("latin-1")
                at += len(rest)
                if not rest:
                    self.end = "cut"
                    if zlibs:
                        yield d.flush()
                    return
            out = d.decompress(rest) if zstd else d.decompress(rest, step)
            rest = d.unconsumed_tail if zlibs else b""
            yield out
        self.used = at - len(d.unused_data)

    def chunks(self, step: int = 1 << 20) -> Iterator[bytes]:
        self.used, self.end = self.start, ""
        magic = self.text[self.start:self.start + 2]
        while not self.end:
            try:
                yield from self._member(step)
            except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError) as e:
                self.end = "refused" if "memory" in str(e).lower() else "broken"
            if not self.end and not (self.text.startswith(magic, self.used, self.stop) and _MAGIC.match(self.text, self.used, self.stop)):
                self.end = "whole"

    def windows(self, most: int) -> Iterator[Layer]:
        """The text in parts of about ``most`` bytes; clears ``whole`` where an
        open run is too long to be carried into the next part."""
        held = b""
        parts: list[bytes] = []
        size = 0
        for chunk in self.chunks(min(1 << 20, most)):
            parts.append(chunk)
            size += len(chunk)
            if len(held) + size < most:
                continue
            held = b"".join([held, *parts])
            parts, size = [], 0
            text, wide = _window_text(held)
            at = _unfinished(text, min(1 << 16, most // 4))
            if at < len(text) - most // 2:
                self.whole, at = False, len(text) - most // 2
            yield Layer(text, self.path, *self.place, carried=at)
            held = held[len(text[:at].encode()) if wide else at:]
        yield Layer(_window_text(b"".join([held, *parts]))[0], self.path, *self.place)


def _window_text(data: bytes) -> tuple[str, bool]:
    """The text, without a last character that is cut, and whether it is UTF-8 (else Latin-1)."""
    try:
        return data.decode(), True
    except UnicodeDecodeError as e:
        if e.start >= len(data) - 3 and e.reason == "unexpected end of data":
            return data[:e.start].decode(), True
        return data.decode("latin-1"), False


def _streams(text: str) -> Iterator[Stream]:
    """The places of a text where a compressed stream may start. A stream that the
    caller has read is not searched for others as far as its whole members go."""
    stop, last = 0, None
    for m in _MAGIC.finditer(text):
        if last is not None and m.start() < last.used:
            continue
        if m.start() >= stop:
            stop = _BYTES.match(text, m.start()).end()
        last = Stream(text, m.start(), stop)
        yield last


def _unfinished(text: str, lap: int) -> int:
    """Where a window that goes on must be taken up again: ``lap`` characters
    before its end, or where an assignment, a base64 run, escaped characters or a
    compressed stream that reaches its end begins."""
    n = len(text)
    at = max(n - lap, 0)
    if m := _OPEN_ASSIGN.search(text):
        at = min(at, m.start())
    for m in _BASE64.finditer(text):
        if m.end() >= n - 4:
            at = min(at, m.start())
    word = max(text.rfind(c) for c in " \n\r\t") + 1
    if word < at and any(c in text[word:] for c in ("%", "\\", "&#")):
        at = word
    for stream in _streams(text):
        if stream.start >= at:
            break
        for _ in stream.chunks():
            pass
        if stream.end == "cut":
            return stream.start
    return at


def _as_text(data: bytes) -> tuple[str, np.ndarray]:
    """The text and the byte offset of each character (and the end): UTF-8, or
    Latin-1 (a character per byte) for other bytes."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1"), np.arange(len(data) + 1)
    if len(text) == len(data):
        return text, np.arange(len(data) + 1)
    raw = np.frombuffer(data, np.uint8)
    return text, np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(data))


def _rewritten(layer: Layer, name: str, pieces: list[tuple[int, int, str, np.ndarray, np.ndarray]]) -> Layer:
    """The layer with the given pieces replaced; other characters stay."""
    texts, starts, ends, at = [], [], [], 0
    for s, e, text, a, b in [*pieces, (len(layer.text), len(layer.text), "", np.empty(0, np.int64), np.empty(0, np.int64))]:
        kept = np.arange(at, s)
        texts += [layer.text[at:s], text]
        starts += [kept, a]
        ends += [kept + 1, b]
        at = e
    return layer.derived("".join(texts), name, np.concatenate(starts), np.concatenate(ends))


def _url(layer: Layer) -> Iterator[Layer]:
    pieces = []
    for m in _URL.finditer(layer.text):
        data = bytes.fromhex(m[0].replace("%", ""))
        try:
            text, offsets = data.decode(), _as_text(data)[1]
        except UnicodeDecodeError:  # raw bytes, possibly compressed: a character per byte
            text, offsets = data.decode("latin-1"), np.arange(len(data) + 1)
        pieces.append((m.start(), m.end(), text, m.start() + 3 * offsets[:-1], m.start() + 3 * offsets[1:]))
    if pieces:
        yield _rewritten(layer, "url", pieces)


def _unicode(layer: Layer) -> Iterator[Layer]:
    pieces: list[tuple[int, int, str, np.ndarray, np.ndarray]] = []
    high: tuple[int, int, int] | None = None
    for m in _UNICODE.finditer(layer.text):
        code = int(m[6]) if m[6] else int(next(x for x in m.groups() if x), 16)
        start = m.start()
        if high and 0xDC00 <= code < 0xE000 and high[1] == start:  # the pair is one character
            code, start = 0x10000 + ((high[2] - 0xD800) << 10) + code - 0xDC00, high[0]
            pieces.pop()
        high = (m.start(), m.end(), code) if 0xD800 <= code < 0xDC00 else None
        char = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"
        pieces.append((start, m.end(), char, np.array([start]), np.array([m.end()])))
    if pieces:
        yield _rewritten(layer, "unicode", pieces)


def _base64_run(layer: Layer, run: str, at: np.ndarray) -> Layer | None:
    """The layer that one run encodes; ``at``: the place of each of its characters.
    A last character that is alone in its group encodes nothing."""
    body = run[:-1] if len(run) % 4 == 1 else run
    data = base64.b64decode((body + "=" * (-len(body) % 4)).translate({45: 43, 95: 47}))
    if not data:
        return None
    text, offsets = _as_text(data)
    first, last = offsets[:-1] * 4 // 3, (offsets[1:] * 4 + 2) // 3 - 1
    return layer.derived(text, "base64", at[first], at[np.minimum(last, len(body) - 1)] + 1)


def _base64(layer: Layer) -> Iterator[Layer]:
    """Each run's lines, and its joined lines read from their first four characters
    on: wherever in the run a code begins, one of the four has its groups."""
    for m in _BASE64.finditer(layer.text):
        lines = list(_BASE64_LINE.finditer(m[0]))
        joined: list[list[re.Match]] = [[]]
        for x in lines:
            joined[-1].append(x)
            if x[3]:  # padding ends a code
                joined.append([])
        for group in [*filter(None, joined), *([x] for x in lines if len(lines) > 1 and len(x[2]) >= 16)]:
            run = "".join(x[2] for x in group)
            at = np.concatenate([np.arange(m.start() + x.start(2), m.start() + x.end(2)) for x in group])
            for k in range(4 if any(group is g for g in joined) else 1):
                if len(run) - k >= 16 and (got := _base64_run(layer, run[k:], at[k:])):
                    yield got


def _compressed(layer: Layer, most: int, oversize: set, unread: set) -> Iterator[Layer | Stream]:
    """The layer that each compressed stream holds; beyond ``most`` bytes the
    stream itself, to be read in windows."""
    path = f"{layer.path}>compressed" if layer.path else "compressed"
    for stream in _streams(layer.text):
        parts, size = [], 0
        for chunk in stream.chunks():
            size += len(chunk)
            if size <= most:
                parts.append(chunk)
        if stream.end == "cut" and layer.carried is not None and stream.start >= layer.carried:
            continue  # the next window has it whole
        stream.path, stream.place = path, layer.place(stream.start, stream.used if stream.end == "whole" else stream.stop)
        if stream.end == "cut":
            stream.used = stream.stop
        if stream.end == "refused" or size > most:
            oversize.add((path, stream.place, hashlib.blake2b(layer.text[stream.start:stream.stop].encode("latin-1"), digest_size=16).digest()))
        if stream.end == "refused":
            unread.add(stream.place)
        if size > most:
            yield stream
        elif size:
            yield Layer(_as_text(b"".join(parts))[0], path, *stream.place)


def _search(first: Layer, most: int, seen: tuple[set, ...], found: dict, oversize: set, unread: set) -> None:
    """Work through a layer and all below it. ``seen``: the marks of the layers
    met, those of each window's inner layers in a set of their own."""
    def new(x: Layer) -> bool:
        mark = (hashlib.blake2b(x.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), x.place(0, len(x.text)) if x.text else None)
        if not x.text or any(mark in s for s in seen):
            return False
        seen[-1].add(mark)
        return True

    work: deque[Layer | Stream] = deque([first])
    while work:
        layer = work.popleft()
        if isinstance(layer, Stream):
            used = layer.used
            for window in layer.windows(most):
                if new(window):
                    _search(window, most, (*seen, set()), found, oversize, unread)
            layer.used = used
            if not layer.whole:
                unread.add(layer.place)
            continue
        for start, kind, end in scan_text(layer.text):
            s, e = layer.place(start, end)
            if (s, kind, e) not in found or _depth(layer.path) < _depth(found[s, kind, e]):
                found[s, kind, e] = layer.path
        nexts: list[Layer | Stream] = []
        if "%" in layer.text:
            nexts += _url(layer)
        if "\\" in layer.text or "&#" in layer.text:
            nexts += _unicode(layer)
        nexts += _base64(layer)
        if layer.path:
            nexts += _compressed(layer, most, oversize, unread)
        work += [x for x in nexts if isinstance(x, Stream) or new(x)]


def _depth(path: str) -> int:
    return path.count(">") + bool(path)


def _find(text: str, most: int) -> tuple[dict[tuple[int, int, int], str], int, set[tuple[int, int]]]:
    found: dict[tuple[int, int, int], str] = {}
    oversize: set = set()
    unread: set[tuple[int, int]] = set()
    _search(Layer(text, ""), most, (set(),), found, oversize, unread)
    return found, len(oversize), unread


def find_secrets(text: str, max_layer_chars: int = 16 << 20) -> tuple[list[tuple[str, int, int, str]], int]:
    """All findings ``(kind, start, end, layer)`` of a text and its nested layers,
    by start, then kind, then end; and how many layers were oversize or refused.

    ``layer`` names the encodings passed, outermost first ('' for the text
    itself); of equal spans the one of the fewest layers stays.
    """
    found, oversize, _ = _find(text, max_layer_chars)
    return [(KINDS[k], s, e, found[s, k, e]) for s, k, e in sorted(found)], oversize


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer_chars: int = 16 << 20) -> DataFrame:
    """``(id, spans, n_oversize)`` of every row; spans in code points, end exclusive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string())]))
        for b in small_batches(batches, 1):
            got = [find_secrets(t, max_layer_chars) for t in strings(b.column(1))]
            spans = [[dict(zip(("kind", "start", "end", "layer"), x)) for x in found] for found, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array([n for _, n in got], pa.int32())], names=[id_col, "spans", "n_oversize"])

    schema = T.StructType([T.StructField(id_col, type_of(docs, id_col)), T.StructField("spans", SPANS), T.StructField("n_oversize", T.IntegerType())])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def redact_text(text: str, mask: str = "[secret]", max_layer_chars: int = 16 << 20) -> str:
    """The text with every finding, of any layer, and every region that could not
    be read whole, replaced by the mask."""
    out, at = [], 0
    found, _, unread = _find(text, max_layer_chars)
    for s, e in sorted({(s, e) for s, _, e in found} | unread):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mask]
        at = e
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The same rows and columns, with secrets masked in the text (null stays null)."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, place):
            texts = pa.array([None if t is None else redact_text(t, mask) for t in b.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == place else c for i, c in enumerate(b.columns)], schema=b.schema.set(place, pa.field(text_col, pa.string())))

    return docs.mapInArrow(run, docs.schema)
