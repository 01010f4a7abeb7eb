"""Column expressions for text: tokenisers, case folding, regex escaping.

Every pattern is a Java regex with ``(?U)`` so ``\\s``, ``\\w`` and ``\\b`` are
Unicode-aware, as they are in Python's ``re`` on ``str``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three tokenisers; they are not interchangeable.
WS_SPLIT = r"(?U)\s+"                    # whitespace words (str.split())
# scikit-learn's default ``\b\w\w+\b``: maximal word runs are matched whole,
# so ``\w{2,}`` finds the same tokens without the costlier Unicode \b checks.
SK_TOKEN = r"(?U)\w{2,}"
TREEBANK_LIKE = r"(?U)\w+(?:[-.@']\w+)*|[^\w\s]"  # word-or-punctuation approximation
WORD_RUN = r"(?U)\w+"                   # maximal word-character runs


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_tokens(text) -> Column:
    """Whitespace tokens, like Python ``str.split()`` (empty text -> [])."""
    return F.filter(F.split(col_of(text), WS_SPLIT), lambda x: x != F.lit(""))


def sk_tokens(text) -> Column:
    """Lower-cased ``\\b\\w\\w+\\b`` tokens (scikit-learn's default analyzer)."""
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit(SK_TOKEN), 0)


def word_punct_tokens(text) -> Column:
    """Lower-cased word/punctuation tokens: punctuation becomes its own token."""
    return F.regexp_extract_all(F.lower(col_of(text)), F.lit(TREEBANK_LIKE), 0)


def fold(text) -> Column:
    """Case fold close to what a case-insensitive Unicode regex treats as equal.

    ``lower`` alone misses a few letters whose case mapping is not one-to-one;
    these are mapped first so that token equality on folded text is implied by
    a case-insensitive regex match.
    """
    c = F.translate(col_of(text), "İ", "i")
    return F.translate(F.lower(c), "ſıς", "siσ")


def word_runs(text) -> Column:
    """Maximal ``\\w+`` runs of the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(WORD_RUN), 0)


def regex_escape(s) -> Column:
    """Escape every character that is not a letter, digit, ``_`` or whitespace.

    A backslash before a non-alphabetic character is always a literal in Java
    regex, so this is safe for any input (unlike ``\\Q..\\E``, which breaks on
    an embedded ``\\E``).
    """
    return F.regexp_replace(col_of(s), r"([^\p{L}\p{N}_\s])", r"\\$1")


def collapse_ws(text) -> Column:
    """``re.sub(r'\\s+', ' ', text.strip())``."""
    return F.regexp_replace(strip_ws(text), WS_SPLIT, " ")


def strip_ws(text) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.regexp_replace(col_of(text), r"(?U)^\s+|\s+$", "")


def strip_chars(text, chars: str) -> Column:
    """Python ``str.strip(chars)``."""
    cls = _cls(chars)
    return F.regexp_replace(col_of(text), "^[" + cls + "]+|[" + cls + "]+$", "")


def _cls(chars: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in chars)


def ngrams(tokens, n: int) -> Column:
    """Contiguous n-grams of a token array, joined by a single space.

    Built from ``n`` shifted slices zipped together, so the token array is
    referenced a fixed number of times per row (a lambda indexing into an
    expression would re-evaluate it per element). Empty when size < n.
    """
    t = col_of(tokens)
    length = F.greatest(F.size(t) - (n - 1), F.lit(0))
    if n == 1:
        return t
    zipped = F.arrays_zip(*[F.slice(t, k + 1, length).alias(f"g{k}") for k in range(n)])
    return F.transform(zipped, lambda s: F.concat_ws(" ", *[s[f"g{k}"] for k in range(n)]))


def last_period_prefix(text) -> Column:
    """Text up to and including its last period; '' when there is none."""
    return F.regexp_extract(col_of(text), r"(?s)^(.*\.)", 1)


def first_paragraphs(text, k: int = 6) -> Column:
    """First ``k`` newline-separated lines joined back and stripped."""
    return strip_ws(F.array_join(F.slice(F.split(col_of(text), "\n"), 1, k), "\n"))
