"""Language identification of mixed-language text.

A word is a run of letters of one script with their combining marks; it ends
where the script changes, so text that runs two scripts together is cut there.
Per-word scores are sums of log probabilities of hashed character trigrams
(word edges included) under one add-alpha model per language. The script of a
word (code point ranges) narrows its candidates to the languages that were seen
to use that script; a Viterbi pass over the words, with a penalty for every
switch, then labels spans. A document's language is the one that holds most of
its letters.

Fitting: trigram counts of a hash sample of at most about
``rows_per_language`` labelled documents a language (a fixed, documented bound;
whole texts), counted inside tasks and summed by Spark. The model has languages
x ``BUCKETS`` cells; more than ``max_languages`` raise. Scoring is one map stage
over whole texts; the Viterbi steps of a batch's documents run side by side.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing was learned. Letters of a script that no language
was seen in count for no language; a text of only such letters gets the most
frequent language with score 0. Ties go to the language that comes first by
code point; null ids pass through; repeated rows repeat their result; an empty
table gives no rows; a very long text is scored whole, a few dozen bytes of working
memory a character; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, strings, type_of

BUCKETS = 1 << 16
_TABLE = 0x30000  # code points from here on count as letters without case

#: Scripts by code point ranges (Unicode blocks); 0 is any other.
SCRIPT_RANGES = ((1, 0x41, 0x24F), (1, 0x1E00, 0x1EFF), (1, 0xFF21, 0xFF5A), (2, 0x370, 0x3FF), (2, 0x1F00, 0x1FFF), (3, 0x400, 0x52F), (4, 0x530, 0x58F), (5, 0x590, 0x5FF),
                 (6, 0x600, 0x6FF), (6, 0x750, 0x77F), (6, 0xFB50, 0xFDFF), (6, 0xFE70, 0xFEFF), (7, 0x900, 0x97F), (8, 0x980, 0x9FF), (9, 0xB80, 0xBFF), (10, 0xE00, 0xE7F), (11, 0x10A0, 0x10FF),
                 (12, 0x1100, 0x11FF), (12, 0x3130, 0x318F), (12, 0xAC00, 0xD7AF), (12, 0xFFA0, 0xFFDC), (13, 0x3040, 0x30FF), (13, 0x31F0, 0x31FF), (13, 0xFF66, 0xFF9F),
                 (14, 0x3005, 0x3007), (14, 0x3400, 0x9FFF), (14, 0xF900, 0xFAFF), (14, 0x20000, 0x2FFFF), (15, 0xA00, 0xA7F), (16, 0xA80, 0xAFF), (17, 0xC00, 0xC7F),
                 (18, 0xC80, 0xCFF), (19, 0xD00, 0xD7F), (20, 0xD80, 0xDFF), (21, 0xE80, 0xEFF), (22, 0x1000, 0x109F), (23, 0x1200, 0x139F), (24, 0x1780, 0x17FF),
                 (25, 0xF00, 0xFFF), (26, 0xB00, 0xB7F), (27, 0x13A0, 0x13FF), (28, 0x1800, 0x18AF))
SCRIPTS = 29
#: Modifier letters, which belong to the script of the letter before them like combining marks.
MODIFIERS = (0x2B0, 0x2FF)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, its lower case, its script, and
    whether it goes with the letter before it."""
    chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(_TABLE)]
    letter = np.array([c.isalpha() for c in chars])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)
    script = np.zeros(_TABLE, np.int8)
    for s, lo, hi in SCRIPT_RANGES:
        script[lo:hi + 1] = s
    mark = np.array([unicodedata.category(c)[0] == "M" for c in chars])
    mark[MODIFIERS[0]:MODIFIERS[1] + 1] = True
    return letter & ~mark, lower, script, mark


@dataclass
class Words:
    """The words of some texts: their places, script, and trigram buckets."""
    start: np.ndarray  # in the joined code points
    end: np.ndarray
    script: np.ndarray
    grams: np.ndarray  # one for each letter
    first: np.ndarray  # of each word, its first letter among the letters


def words_of(text: str) -> Words:
    """Runs of letters of one script, with the marks that follow a letter: a word
    ends where the script changes, so each has one script."""
    letter, lower, script, mark = _tables()
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.minimum(code, _TABLE - 1)
    inside = code < _TABLE
    is_letter, is_mark = np.where(inside, letter[known], True), inside & mark[known]
    at = np.arange(len(code))
    owner = np.maximum.accumulate(np.where(is_mark, -1, at)) if len(code) else at  # the last place that is no mark
    in_word = is_letter | (is_mark & (owner >= 0) & is_letter[owner])
    own = np.where(inside, script[known], 0)[np.maximum(owner, 0)]
    begins = in_word.copy()
    begins[1:] &= ~in_word[:-1] | (own[1:] != own[:-1])
    ends = in_word.copy()
    ends[:-1] &= ~in_word[1:] | begins[1:]
    low = np.where(in_word, np.where(inside, lower[known], code), 0).astype(np.uint64)
    before, after = np.concatenate([[0], low])[:-1].astype(np.uint64), np.concatenate([low, [0]])[1:].astype(np.uint64)
    before[begins], after[ends] = 0, 0
    mixed = before * np.uint64(0x9E3779B97F4A7C15) + low * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    grams = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48))[in_word].astype(np.int64)
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.concatenate([[0], np.cumsum(end - start)])[:-1]
    return Words(start, end, own[start], grams, first)


# -- model ------------------------------------------------------------------

@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages
    allowed: np.ndarray  # SCRIPTS x languages
    prior: np.ndarray
    switch: float


def _count(rows: DataFrame) -> DataFrame:
    """``(lang, cell, n)``: trigram buckets, and BUCKETS + script for letters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in small_batches(batches, 0):
            langs = b.column(1).to_pylist()
            texts = strings(b.column(0))
            for lang in set(langs):
                w = words_of("\n".join(t for t, x in zip(texts, langs) if x == lang))
                n = held.setdefault(lang, np.zeros(BUCKETS + SCRIPTS, np.int64))
                n[:BUCKETS] += np.bincount(w.grams, minlength=BUCKETS)
                n[BUCKETS:] += np.bincount(w.script, weights=w.end - w.start, minlength=SCRIPTS).astype(np.int64)
        for lang, n in held.items():
            cells = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(n[cells])], names=["lang", "cell", "n"])

    return rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        rows_per_language: int = 20_000, max_languages: int = 1000, alpha: float = 0.05, switch_penalty: float = 8.0) -> Model | None:
    """The model of the training rows, or None if they hold no letter."""
    c = lambda n: F.col(f"`{n}`")
    rows = docs.filter(training & c(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(c(lang_col)).count().limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return None
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows_per_language / n))]), c(lang_col))
    draw = F.pmod(F.xxhash64(c(id_col), c(text_col), F.lit("language-id")), F.lit(1 << 30)) / float(1 << 30)
    cells = _count(rows.filter(draw < rate).select(c(text_col).cast("string"), c(lang_col))).collect()
    languages = sorted({r.lang for r in cells})
    if not languages:
        return None
    n = np.zeros((BUCKETS + SCRIPTS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    for r in cells:
        n[r.cell, place[r.lang]] = r.n
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    log_p = np.log(grams + alpha) - np.log(grams.sum(0) + alpha * BUCKETS)
    prior = np.log(np.array([counts[x] for x in languages]) / sum(counts[x] for x in languages))
    return Model(languages, log_p.astype(np.float32), scripts >= 0.01 * scripts.sum(0), prior, switch_penalty)


# -- scoring ----------------------------------------------------------------

def word_scores(m: Model, w: Words) -> np.ndarray:
    """words x languages; a word's script rules out the languages not seen in it."""
    if not len(w.start):
        return np.zeros((0, len(m.languages)), np.float32)
    scores = np.concatenate([np.add.reduceat(m.log_p[w.grams[a:b]], first - a, axis=0) for a, b, first in _chunks(w)])
    allowed = m.allowed[w.script]
    known = allowed.any(1)
    return np.where(known[:, None], np.where(allowed, scores, scores.min(1, keepdims=True) - 100), 0).astype(np.float32)


def _chunks(w: Words, letters: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of whole words with about so many letters each."""
    total = len(w.grams)
    marks = [0, *np.unique(np.searchsorted(w.first, np.arange(letters, total, letters))).tolist(), len(w.first)]
    for i, j in zip(marks, marks[1:]):
        if i < j:
            yield int(w.first[i]), int(w.first[j]) if j < len(w.first) else total, w.first[i:j]


def viterbi(scores: np.ndarray, lengths: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word; documents lie one after another in ``scores``."""
    n_lang = scores.shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), "right")  # documents of at least t + 1 words
    back = np.empty((len(scores), n_lang), np.int16)
    value = np.tile(prior, (len(lengths), 1))
    own = np.arange(n_lang, dtype=np.int16)
    for t, n in enumerate(live):
        v, at = value[:n], starts[:n] + t
        if t:
            best = v.argmax(1)
            jump = v[np.arange(n), best][:, None] - penalty
            moved = jump > v
            back[at] = np.where(moved, best[:, None], own)
            np.maximum(v, jump, out=v)
        v += scores[at]
    labels = np.empty(len(scores), np.int16)
    state = value.argmax(1).astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return labels


def label(m: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text: language, score, and spans ``(start, end, language)``."""
    each = [words_of(t) for t in texts]
    lengths = np.array([len(w.start) for w in each], np.int64)
    found = viterbi(np.concatenate([word_scores(m, w) for w in each]), lengths, m.prior, m.switch) if each else []
    out, at = [], 0
    for w, n in zip(each, lengths):
        mine, at = found[at:at + n], at + n
        if not n:
            out.append(("und", 0.0, []))
            continue
        size = w.end - w.start
        held = np.bincount(mine, weights=np.where(m.allowed[w.script].any(1), size, 0), minlength=len(m.languages))
        best = int(held.argmax()) if held.any() else int(m.prior.argmax())
        cut = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1])
        last = np.concatenate([cut[1:], [n]]) - 1
        out.append((m.languages[best], float(held[best] / size.sum()), [(int(w.start[a]), int(w.end[b]), m.languages[mine[a]]) for a, b in zip(cut, last)]))
    return out


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, spans)`` of every row; spans in code points."""
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast(model)  # languages x BUCKETS cells, bounded by max_languages
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in small_batches(batches, 1, 8 << 20):
            texts = strings(b.column(1))
            got = label(m, texts) if m is not None else [("und", 0.0, []) for _ in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                                              pa.array([[dict(zip(("start", "end", "lang"), s)) for s in g[2]] for g in got], spans)], names=[id_col, "lang_pred", "score", "spans"])

    schema = T.StructType([T.StructField(id_col, type_of(docs, id_col)), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])))])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)
