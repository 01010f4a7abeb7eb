"""Porter's suffix-stripping steps (1980) as column expressions.

``y`` after a consonant is a vowel; here such words are handled by writing every
consonant ``y`` as ``Y`` first. The measure of a stem (its number of
vowel-consonant sequences) and the other conditions are regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_V, _C = "[aeiouy]", "[^aeiouy]"
MEASURE_1 = f"^{_C}*{_V}+{_C}"                  # m > 0
MEASURE_2 = f"^{_C}*{_V}+{_C}+{_V}+{_C}"        # m > 1
JUST_1 = f"^{_C}*{_V}+{_C}+{_V}*$"              # m = 1
DOUBLE = r"([^aeiouy])\1$"
SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$"        # *o

# Suffix and replacement of the algorithm's steps 2 to 4, in its order.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _cut(w: Column, suffix: str) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - len(suffix))


def _longest_rule(w: Column, rules: list[tuple[str, object]]) -> Column:
    """The outcome of the longest suffix that fits; the word if none does."""
    out = w
    for suffix, outcome in sorted(rules, key=lambda r: len(r[0])):
        out = F.when(F.endswith(w, F.lit(suffix)), outcome(_cut(w, suffix))).otherwise(out)
    return out


def _replace(w: Column, rules, measure: str) -> Column:
    rule = lambda suffix, new: (suffix, lambda stem: F.when(stem.rlike(measure), F.concat(stem, F.lit(new))).otherwise(w))
    return _longest_rule(w, [rule(s, n) for s, n in rules])


#: The steps, each a function of the word so far; apply them in separate
#: projections, or the expression of a step is copied into every use.
def mark_y(w: Column) -> Column:
    """Consonant y as Y: at the start, after a vowel, and so on alternately."""
    w = F.regexp_replace(w, "^y", "Y")
    return F.regexp_replace(F.regexp_replace(w, "([aeiou])y", "$1Y"), "yy", "yY")


def step_1a(w: Column) -> Column:
    return _longest_rule(w, [("sses", lambda s: F.concat(s, F.lit("ss"))), ("ies", lambda s: F.concat(s, F.lit("i"))), ("ss", lambda _: w), ("s", lambda s: s)])


def step_1b(w: Column) -> Column:
    """Removed endings are marked by a final ``+`` for the repair that follows."""
    drop = lambda s: F.when(s.rlike(_V), F.concat(s, F.lit("+"))).otherwise(w)
    return _longest_rule(w, [("eed", lambda s: F.when(s.rlike(MEASURE_1), F.concat(s, F.lit("ee"))).otherwise(w)), ("ed", drop), ("ing", drop)])


def step_1b_repair(w: Column) -> Column:
    stem = F.regexp_replace(w, r"\+$", "")
    fixed = (F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
             .when(stem.rlike(DOUBLE) & ~stem.rlike("[lsz]$"), F.substring(stem, F.lit(1), F.length(stem) - 1))
             .when(stem.rlike(JUST_1) & stem.rlike(SHORT), F.concat(stem, F.lit("e"))).otherwise(stem))
    return F.when(F.endswith(w, F.lit("+")), fixed).otherwise(w)


def step_1c(w: Column) -> Column:
    return F.when(w.rlike(f"{_V}.*[yY]$"), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("i"))).otherwise(w)


def step_2(w: Column) -> Column:
    return _replace(w, STEP_2, MEASURE_1)


def step_3(w: Column) -> Column:
    return _replace(w, STEP_3, MEASURE_1)


def step_4(w: Column) -> Column:
    def rule(suffix: str):
        fits = lambda s: (s.rlike(MEASURE_2) & s.rlike("[st]$")) if suffix == "ion" else s.rlike(MEASURE_2)
        return suffix, lambda s: F.when(fits(s), s).otherwise(w)
    return _longest_rule(w, [rule(s) for s in STEP_4])


def step_5(w: Column) -> Column:
    stem = F.substring(w, F.lit(1), F.length(w) - 1)
    without = F.when(F.endswith(w, F.lit("e")) & (stem.rlike(MEASURE_2) | (stem.rlike(JUST_1) & ~stem.rlike(SHORT))), stem).otherwise(w)
    double = without.rlike("ll$") & F.substring(without, F.lit(1), F.length(without) - 1).rlike(MEASURE_2)
    return F.lower(F.when(double, F.substring(without, F.lit(1), F.length(without) - 1)).otherwise(without))


STEPS = (mark_y, step_1a, step_1b, step_1b_repair, step_1c, step_2, step_3, step_4, step_5)


def with_stems(words, column: str, out: str = "stem"):
    """``words`` with the stem of a column of lower-case words of more than two
    letters. Write the result before filtering on the stem: a filter that moves
    below the steps would copy each into the next."""
    keep = words.columns
    df = words.withColumn("_w", F.col(column))
    for step in STEPS:
        df = df.select(*[F.col(f"`{c}`") for c in keep], step(F.col("_w")).alias("_w"))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.when(F.length(column) > 2, F.col("_w")).otherwise(F.col(column)).alias(out))
