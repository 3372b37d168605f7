"""Column functions on text: cleaning, entities, truncation, similarity. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks and tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def short_text_tag(c: Column, least: int = 10, tag: str = "unknown") -> Column:
    """``tag`` for null or fewer than ``least`` stripped characters, else null."""
    return F.when(F.coalesce(F.length(strip(c)), F.lit(0)) < least, tag)


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    """The first ``n`` characters, with ``mark`` where something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


# Prefixes that a claim may carry, in the order in which they are removed.
CLAIM_PREFIXES = [
    r"normalized\s*claim\s*:\s*",
    r"the\s*claim\s*is\s*:\s*",
    r"the\s*claim\s*is\s+that\s+",
    r"the\s*normalized\s*claim\s*:\s*",
    r"claim\s*:\s*",
    r"output\s*:\s*",
    r"answer\s*:\s*",
    r"here\s*is\s*the\s*normalized\s*claim\s*:\s*",
]


def unquote(c: Column) -> Column:
    """Without one pair of equal quotes around it."""
    return F.when(c.rlike("(?s)^\".*\"$") & (F.length(c) > 1) | c.rlike("(?s)^'.*'$") & (F.length(c) > 1), strip(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c)


def normalize_claim(c: Column) -> Column:
    """A model's answer as one claim: unquoted, without prefixes, its first line, without marks at the ends, with a final period."""
    c = unquote(strip(c))
    for p in CLAIM_PREFIXES:
        c = F.regexp_replace(c, f"(?i)^{p}", "")
    c = strip(F.element_at(F.split(c, "\n", -1), 1))
    c = F.when(c.endswith("..."), strip(F.regexp_replace(c, r"\.\.\.$", ""))).otherwise(c)
    c = F.regexp_replace(unquote(c), r"^[*_`]+|[*_`]+$", "")
    return F.when((F.length(c) > 0) & ~c.rlike(r"[.!?]$"), F.concat(c, F.lit("."))).otherwise(c)


_LETTER = r"[\p{L}\p{N}_]"


def _whole(pattern: str, flags: str = "") -> str:
    """``pattern`` where no letter, digit or underscore stands beside it."""
    return f"{flags}(?<!{_LETTER})(?:{pattern})(?!{_LETTER})"


# Patterns of entities.
NUMBER = r"\$?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?%?"
DATE = _whole(r"\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}|\p{Nd}{4}[/-]\p{Nd}{1,2}[/-]\p{Nd}{1,2}")
MONTH_DAY = _whole(r"(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\p{Nd}{1,2}(?:,?\s+\p{Nd}{4})?", "(?i)")
PHRASE = _whole(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+")
NOT_WORD = r"[^\p{L}\p{N}_]"


def extract_entities(c: Column) -> Column:
    """Sorted array of numbers, dates, month-days, capitalised words that do not begin a sentence, and capitalised phrases, in lower case.

    Dates, month-days and phrases stand between word boundaries: what a letter or digit goes on is cut back to the last word or is none.
    """
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in (NUMBER, DATE, MONTH_DAY, PHRASE)]
    inner = F.transform(F.split(c, r"[.!?]\s+", -1), lambda s: F.filter(F.split(s, r"\s+", -1), lambda w: F.length(w) > 0))
    later = F.flatten(F.transform(inner, lambda ws: F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1)))))
    named = F.filter(later, lambda w: w.rlike(r"^\p{Lu}") & (w != F.upper(w)) & (F.length(w) > 1))
    clean = F.filter(F.transform(named, lambda w: F.regexp_replace(w, NOT_WORD, "")), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found, clean), lambda x: F.lower(x))))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets: 0.5 if both are empty, 0 if one is."""
    none = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(none, 0.5).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def replace_non_finite(c: Column, nan: float, posinf: float, neginf: float) -> Column:
    """NaN and null, +Inf and -Inf by the given values."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c), nan).when(c == float("inf"), posinf).when(c == float("-inf"), neginf).otherwise(c)


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def count_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two arrays of words, of any length; 0 if a side is empty, null words do not count.

    The words of both are sorted together and counted in one walk, so that whole texts take hardly more than their length. Both are named once.
    """
    side = lambda ws, second: F.transform(F.filter(ws, lambda w: w.isNotNull()), lambda w: F.struct(w.alias("w"), F.lit(second).alias("second")))
    start = F.struct(F.lit(None).cast("string").alias("w"), *[F.lit(0.0).alias(c) for c in ("x", "y", "xx", "yy", "xy")])

    def step(s: Column, t: Column) -> Column:
        """x and y: how often the word came so far, on either side; one more adds 2x + 1 to a sum of squares and the other side's number to that of products."""
        so_far = lambda c: F.when(s["w"] == t["w"], s[c]).otherwise(0.0)
        x, y, second = so_far("x"), so_far("y"), t["second"]
        first_side = (x + 1).alias("x"), y.alias("y"), (s["xx"] + 2 * x + 1).alias("xx"), s["yy"].alias("yy"), (s["xy"] + y).alias("xy")
        second_side = x.alias("x"), (y + 1).alias("y"), s["xx"].alias("xx"), (s["yy"] + 2 * y + 1).alias("yy"), (s["xy"] + x).alias("xy")
        return F.when(second, F.struct(t["w"].alias("w"), *second_side)).otherwise(F.struct(t["w"].alias("w"), *first_side))

    def cosine(s: Column) -> Column:
        norm = F.sqrt(s["xx"]) * F.sqrt(s["yy"])
        return F.when(norm > 0, s["xy"] / norm).otherwise(0.0)

    return F.coalesce(F.aggregate(F.sort_array(F.concat(side(a, False), side(b, True))), start, step, cosine), F.lit(0.0))
