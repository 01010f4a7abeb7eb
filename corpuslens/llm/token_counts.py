"""Token counts per section by offset-mapped attribution.

A whole document is encoded once, without its section borders, as a model would
read it. The byte-level BPE tokens of a text are, end to end, its UTF-8 bytes, so
the running sum of token lengths gives every token's bytes, and with them its
character span. The spans are joined with the sections' intervals by binary
search inside the task (both are sorted), so no token is ever shuffled. A token
that crosses a border goes by the chosen rule:

* ``most``: to the section that holds most of its characters (ties: the first);
* ``first``: to the section of its first character;
* ``share``: to each section in proportion to its characters.

Counts of a document always add up to its number of tokens; tokens outside all
sections are counted under section -1.

The vocabulary is a parameter (a rank file); its bytes, about 1 MB whatever the
corpus, are broadcast, so executors need no file.

Defined results: a null or empty text has no token and one empty section when
sections are lines; null ids pass through; repeated rows are repeated; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, strings, type_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's public pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("most", "first", "share")
SECTIONS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """The encoder, and the number of bytes of each token."""
    import tiktoken
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(pairs.values()) + 1, np.int64)
    for token, rank in pairs.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={}), sizes


def token_spans(text: str, ranks: bytes, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens, ends exclusive; tokens that are parts of
    one character share it."""
    coder, sizes = encoding(ranks, pattern)
    ends = np.cumsum(sizes[np.array(coder.encode_ordinary(text), np.int64)])
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(ends):
        return ends, ends
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    starts = np.concatenate([[0], ends[:-1]])
    return char[starts], char[ends - 1] + 1


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines as sections; a line break belongs to the line it ends."""
    cuts = [i + 1 for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
    if cuts and cuts[-1] == len(text):
        cuts.pop()
    return np.array([0, *cuts]), np.array([*cuts, len(text)])


def attribute(starts: np.ndarray, ends: np.ndarray, sec_starts: np.ndarray, sec_ends: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and last the tokens outside all; tokens that
    cross the section's end. Sections are sorted and disjoint."""
    n = len(sec_starts)
    count, crossing = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if not n or not len(starts):
        count[n] = len(starts)
        return count, crossing
    first = np.searchsorted(sec_ends, starts, "right")  # the first section that ends after the token's start
    last = np.searchsorted(sec_starts, ends, "left") - 1  # the last that starts before its end
    inside = (first == last) & (sec_starts[np.minimum(first, n - 1)] <= starts) & (ends <= sec_ends[np.minimum(first, n - 1)])
    count[:n] += np.bincount(first[inside], minlength=n)[:n]
    for t in np.flatnonzero(~inside):  # at most a token or two for each border
        a, b, size = int(first[t]), int(last[t]), int(ends[t] - starts[t])
        held = [(s, int(min(ends[t], sec_ends[s]) - max(starts[t], sec_starts[s]))) for s in range(a, b + 1) if sec_ends[s] > sec_starts[s]]
        free = size - sum(x for _, x in held)
        for s, _ in held:
            crossing[s] += ends[t] > sec_ends[s]
        if rule == "share":
            for s, x in held:
                count[s] += x / size
            count[n] += free / size
        elif rule == "first":
            count[held[0][0] if held and sec_starts[held[0][0]] <= starts[t] else n] += 1
        else:
            best = max(held, key=lambda h: (h[1], -h[0]), default=(n, 0))
            count[best[0] if best[1] >= free else n] += 1
    return count, crossing


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None,
                   rule: str = "most", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(id, section, start, end, n_tokens, n_crossing, doc_tokens)``, a row a
    section; ``sections_col`` holds sorted disjoint ``(start, end)`` character
    spans (None: the text's lines)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            rows: list[list] = [[], [], [], [], [], []]
            owner: list[int] = []
            given = b.column(2).to_pylist() if sections_col else [None] * b.num_rows
            for i, (text, spans) in enumerate(zip(strings(b.column(1)), given)):
                starts, ends = token_spans(text, ranks.value, pattern)
                if sections_col:
                    spans = [s for s in spans or [] if s is not None]
                    a, z = np.array([s["start"] for s in spans], np.int64), np.array([s["end"] for s in spans], np.int64)
                else:
                    a, z = lines(text)
                count, crossing = attribute(starts, ends, a, z, rule)
                n = len(a) + (count[-1] > 0)
                owner += [i] * n
                for col, values in zip(rows, ([*range(len(a)), -1][:n], [*a.tolist(), None][:n], [*z.tolist(), None][:n], count[:n].tolist(), crossing[:n].tolist(), [len(starts)] * n)):
                    col += values
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, k) for c, k in zip(rows, kinds))],
                                             names=[id_col, "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"])

    schema = T.StructType([T.StructField(id_col, type_of(docs, id_col)), *(T.StructField(n, T.IntegerType()) for n in ("section", "start", "end")),
                           T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType()), T.StructField("doc_tokens", T.LongType())])
    cols = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")]
    return docs.select(*cols, *([F.col(f"`{sections_col}`").cast(SECTIONS)] if sections_col else [])).mapInArrow(run, schema)


def join_fields(df: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """Adds ``text``, the fields one after another, and ``sections``, their spans
    (a null field is empty)."""
    texts = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for t in texts:
        spans.append(F.struct(at.cast("int").alias("start"), (at + F.char_length(t)).cast("int").alias("end")))
        at = at + F.char_length(t) + len(separator)
    return df.withColumns({"text": F.concat_ws(separator, *texts), "sections": F.array(*spans)})
