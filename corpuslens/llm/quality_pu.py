"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled
web text, a mixture of good and bad in unknown shares. An additive logistic
model over binned text statistics minimises the
non-negative unbiased risk

    prior * E_pos[loss(+1)] + max(0, E_unl[loss(-1)] - prior * E_pos[loss(-1)])

with the class prior estimated from the same two samples: the least ratio of
unlabelled to positive mass above any score of a first, plain
positive-against-unlabelled fit (measured on the half it was not fitted on).

Statistics are made from whole texts in one map stage and written once; the fit
takes hash samples of about ``sample_rows`` positives and as many unlabelled
rows (a fixed, documented bound) to the driver; scoring is a second narrow map.

Defined results: null and empty texts have statistics 0 and are scored like any
other; without a positive row every score is the neutral 0.5; of an id with
several labels one positive label suffices; null ids are never learned from and
never held out; repeated rows repeat their score; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import small_batches, strings, type_of

STATISTICS = ("log_words", "distinct_words", "commonest_word", "distinct_pairs", "upper", "punctuation", "symbols", "digits", "word_length",
              "wordless", "marked_words", "distinct_lines", "line_words", "longest_word")
_TABLE = 0x3000  # code points from here on count as letters without case
_UPPER, _LETTER, _DIGIT, _SPACE, _POINT, _SYMBOL = range(6)


@cache
def _classes() -> np.ndarray:
    """The class of each code point; marks of prose are told from other symbols."""
    def kind(c: str) -> int:
        if c.isupper():
            return _UPPER
        if c.isalpha():
            return _LETTER
        if c.isdigit():
            return _DIGIT
        if c.isspace():
            return _SPACE
        return _POINT if c in ".,;:!?'\"()-" else _SYMBOL
    return np.array([kind(chr(i)) for i in range(_TABLE)], np.uint8)


def statistics(text: str) -> list[float]:
    """The values of STATISTICS for one text."""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(np.where(code < _TABLE, _classes()[np.minimum(code, _TABLE - 1)], _LETTER), minlength=6)
    letters, visible = max(1, n[_UPPER] + n[_LETTER]), max(1, len(code) - n[_SPACE])
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    size = len(words)
    plain = sum(k for w, k in counts.items() if w[-1:].isalnum())
    wordless = sum(k for w, k in counts.items() if len(w) <= 2 and not any(c.isalnum() for c in w))
    return [float(np.log1p(size)), len(counts) / size, max(counts.values()) / size, len(set(zip(words, words[1:]))) / max(1, size - 1),
            n[_UPPER] / letters, n[_POINT] / visible, n[_SYMBOL] / visible, n[_DIGIT] / visible, visible / size, wordless / size, 1 - plain / size,
            len(set(lines)) / len(lines), float(np.log1p(size / len(lines))), float(np.log1p(max(map(len, counts))))]


def featurise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, x)`` of every row, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            x = [statistics(t) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float32()))], names=[id_col, "x"])

    schema = T.StructType([T.StructField(id_col, type_of(docs, id_col)), T.StructField("x", T.ArrayType(T.FloatType()))])
    return materialise(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema), "statistics")


@dataclass
class Model:
    edges: list[np.ndarray]  # of each statistic
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(x, self.edges) @ self.weights + self.bias, -30, 30)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Quantiles, where the bulk lies, and even steps over the range, where the rare bad texts lie."""
    return [np.unique(np.concatenate([np.quantile(c, np.arange(1, bins) / bins), np.linspace(c.min(), c.max(), bins + 1)[1:-1]])) for c in x.T]


def design(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Thermometer coding: of each statistic, which of its edges are passed."""
    return np.concatenate([x[:, i:i + 1] > e for i, e in enumerate(edges)], axis=1).astype(np.float32)


def minimise(pos: np.ndarray, unl: np.ndarray, prior: float | None, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of the least non-negative risk, by Adam over the full samples
    (``prior`` None: plain logistic regression of positive against unlabelled)."""
    w = np.zeros(pos.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    mean = lambda a, r: np.concatenate([r.astype(a.dtype) @ a, [r.sum()]]) / len(a)
    for t in range(1, steps + 1):
        now = w[:-1].astype(pos.dtype)
        sp, su = sigma((pos @ now).astype(np.float64) + w[-1]), sigma((unl @ now).astype(np.float64) + w[-1])
        grad_pos, grad_unl = mean(pos, sp - 1), mean(unl, su)
        if prior is None:
            grad = grad_pos + grad_unl
        else:
            grad_neg = grad_unl - prior * mean(pos, sp)
            negative = np.mean(np.logaddexp(0, np.log(su + 1e-12) - np.log1p(1e-12 - su))) - prior * np.mean(np.logaddexp(0, np.log(sp + 1e-12) - np.log1p(1e-12 - sp)))
            grad = prior * grad_pos + grad_neg if negative >= 0 else -grad_neg
        grad[:-1] += ridge * w[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w = w - rate * first / (1 - 0.9 ** t) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(pos: np.ndarray, unl: np.ndarray, least_share: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of unlabelled to
    positive mass above a threshold that keeps at least ``least_share`` of the
    positives, with a confidence term for the sample sizes."""
    at = np.quantile(pos, 1 - np.linspace(least_share, 1.0, 200))
    share_pos = np.array([(pos >= t).mean() for t in at])
    share_unl = np.array([(unl >= t).mean() for t in at])
    doubt = np.sqrt(np.log(40) / 2 / len(pos)) + np.sqrt(np.log(40) / 2 / len(unl))
    k = int(np.argmin((share_unl + doubt) / share_pos))
    return float(np.clip(share_unl[k] / share_pos[k], 0.01, 0.99))


def fit_samples(pos: np.ndarray, unl: np.ndarray, bins: int = 12) -> Model:
    edges = bin_edges(np.concatenate([pos, unl]), bins)
    p, u = design(pos, edges), design(unl, edges)
    w, b = minimise(p[::2], u[::2], None)
    rest = lambda a: a[1::2] if len(a) > 1 else a
    prior = estimate_prior(rest(p) @ w + b, rest(u) @ w + b)
    w, b = minimise(p, u, prior)
    return Model(edges, w, b, prior)


def fit(features: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = 20_000) -> Model | None:
    """The model of the training rows; None without a positive one."""
    c = F.col(f"`{id_col}`")
    draw = F.pmod(F.xxhash64(c, F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    good = labels.filter(training & (F.col(f"`{label_col}`") == 1)).select(c).distinct()
    unl = features.filter(training)

    def sample(rows: DataFrame, n: int) -> np.ndarray:
        got = rows.filter(draw < sample_rows / n).select("x").toPandas() if n > sample_rows else rows.select("x").toPandas()
        return np.array(got["x"].tolist(), np.float64).reshape(-1, len(STATISTICS))

    n_good, n_unl = good.count(), unl.count()
    pos = sample(features.join(good, id_col, "left_semi"), n_good)
    others = sample(unl, n_unl)
    return fit_samples(pos, others) if len(pos) and len(others) else None


def score(features: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """``(id, score)`` of every row of ``featurise``'s result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            s = model.score(x) if model is not None else np.full(b.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=[id_col, "score"])

    return features.select(F.col(f"`{id_col}`"), "x").mapInArrow(run, T.StructType([features.schema[id_col], T.StructField("score", T.DoubleType())]))


def keep(docs: DataFrame, model: Model | None, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``least``."""
    if model is None:
        return docs if least <= 0.5 else docs.limit(0)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, place):
            x = np.array([statistics(t) for t in strings(b.column(place))])
            yield b.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
