"""Penn Treebank tokens as an ordered list of rewritings, in column expressions.

The text is taken sentence by sentence: only a sentence's last period is a token
of its own, so abbreviations inside keep theirs. Patterns use no look-around, so
every regex engine reads them alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public Treebank conventions, in order; \1.. are groups.
RULES = (
    (r'^"', "`` "),
    (r'([ (\[{<])"', r"\1 `` "),
    (r"\.\.\.", " ... "),
    (r"([,:])([^0-9])", r" \1 \2"),
    (r"([,:])$", r" \1 "),
    (r"[;@#$%&]", r" \0 "),
    (r"([^.])([.])([\])}>\"']*)[ \t]*$", r"\1 \2\3 "),
    (r"[?!]", r" \0 "),
    (r"[\]\[(){}<>]", r" \0 "),
    (r"--", " -- "),
    (r"$", " "),
    (r"^", " "),
    (r'"', " '' "),
    (r"([^' ])' ", r"\1 ' "),
    (r"'([sSmMdD]) ", r" '\1 "),
    (r"'(ll|LL|re|RE|ve|VE) ", r" '\1 "),
    (r"(n't|N'T) ", r" \1 "),
    (r"(?i) (can)(not) ", r" \1 \2 "),
    (r"(?i) (d)('ye) ", r" \1 \2 "),
    (r"(?i) (gim)(me) ", r" \1 \2 "),
    (r"(?i) (gon)(na) ", r" \1 \2 "),
    (r"(?i) (got)(ta) ", r" \1 \2 "),
    (r"(?i) (lem)(me) ", r" \1 \2 "),
    (r"(?i) (more)('n) ", r" \1 \2 "),
    (r"(?i) ('t)(is) ", r" \1 \2 "),
    (r"(?i) ('t)(was) ", r" \1 \2 "),
    (r"(?i) (wan)(na) ", r" \1 \2 "),
)

#: Runs of rules that change nothing where a text is missing: first: (end, the text as a literal or pattern).
NEEDED = {0: (2, '"'), 2: (3, "..."), 9: (10, "--"), 12: (13, '"'), 13: (17, "'"),
          17: (27, re.compile(r"(?i) (?:cannot|d'ye|gimme|gonna|gotta|lemme|more'n|'tis|'twas|wanna) "))}


def _java(replacement: str) -> str:
    out = replacement.replace("$", r"\$")
    for k in range(4):
        out = out.replace(f"\\{k}", f"${k}")
    return out


def _rewritten(text: Column, first: int, end: int) -> Column:
    for pattern, replacement in RULES[first:end]:
        text = F.regexp_replace(text, pattern, _java(replacement))
    return text


def _run(text: Column, first: int, end: int, need: str | re.Pattern) -> Column:
    """Rules first to end of a text that holds what they need; another text as it is."""
    def one(t: Column) -> Column:
        holds = F.contains(t, F.lit(need)) if isinstance(need, str) else t.rlike(need.pattern)
        return F.when(holds, _rewritten(t, first, end)).otherwise(t)
    return F.transform(F.array(text), one)[0]  # the text is named once, so it is computed once


def treebank_tokens(sentence: Column) -> Column:
    """Tokens of one sentence; runs of rules are skipped where they would change nothing."""
    text, k = sentence, 0
    while k < len(RULES):
        end, need = NEEDED.get(k, (k + 1, None))
        text = _rewritten(text, k, end) if need is None else _run(text, k, end, need)
        k = end
    return F.filter(F.split(text, r"\s+"), lambda t: t != F.lit(""))


def treebank_sql(sentence: str) -> str:
    """The same tokens in the SQL of an engine with RE2 patterns."""
    text = sentence
    for pattern, replacement in RULES:
        text = "regexp_replace({}, '{}', '{}', 'g')".format(text, pattern.replace("'", "''"), replacement.replace("'", "''"))
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda t: t <> '')"
