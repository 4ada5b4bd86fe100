"""Text scalars: thin names over built-in functions, plus keyword cutting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.strip() and str.split() treat as white space,
# as a pattern and as plain text.
SPACE = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Remove all leading and trailing white space (``trim`` removes blanks only)."""
    return F.trim(_c(c), F.lit(SPACE_CHARS))


def title(c: str | Column) -> Column:
    return F.initcap(_c(c))


def find(c: str | Column, sub: str | Column, start: Column | int = 1) -> Column:
    """1-based position of ``sub`` at or after ``start``; 0 when absent."""
    sub = F.lit(sub) if isinstance(sub, str) else sub
    return F.call_function("locate", sub, _c(c), F.lit(start) if isinstance(start, int) else start)


def contains_any(c: str | Column, words: list[str]) -> Column:
    c = _c(c)
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def snippet(c: str | Column, n: int = 200) -> Column:
    return F.substring(_c(c), 1, n)


def word_count(c: str | Column) -> Column:
    s = strip_ws(c)
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.size(F.split(s, f"{SPACE}+")))


def rx(c: str | Column, pattern: str, group: int = 1) -> Column:
    """First match of a group; NULL when the pattern or the group does not match."""
    return F.nullif(F.regexp_extract(_c(c), pattern, group), F.lit(""))


def rx_all(c: str | Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group))


def safe_int(c: str | Column) -> Column:
    """Integer or NULL; ``12.5`` is not an integer."""
    return strip_ws(c).try_cast("int")


def safe_double(c: str | Column) -> Column:
    """Decimal number or NULL; the suffixes and hex forms Java would take are not numbers."""
    c = _c(c)
    return F.when(c.rlike(rf"^[0-9+.eE{SPACE[1:-1]}-]+$"), strip_ws(c).try_cast("double"))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once; NULL stays NULL."""
    return F.get(F.transform(F.filter(F.array(value), lambda v: v.isNotNull()), fn), F.lit(0))


def word_to_number(c: str | Column, words: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.try_element_at(table, _c(c))


def regex_escape(c: str | Column) -> Column:
    """Escape pattern characters so the text matches itself."""
    return F.regexp_replace(_c(c), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def cut_between_keywords(c: str | Column, keywords: list[str], extra: int, label: str) -> Column:
    """Text from each keyword's first occurrence to the next other keyword.

    One ``(label, forecast)`` struct per keyword found, in list order, where
    the trimmed cut is longer than the keyword by more than ``extra`` characters.
    """
    c = _c(c)
    words = F.array(*[F.lit(w) for w in keywords])
    present = F.filter(words, lambda w: c.contains(w))

    def cuts(hits: Column) -> Column:
        spots = F.transform(hits, lambda w: F.struct(w.alias("word"), find(c, w).alias("at")))

        def cut(s: Column) -> Column:
            after = s["at"] + F.length(s["word"])
            ends = F.transform(hits, lambda o: F.when(o != s["word"], F.nullif(find(c, o, after), F.lit(0))))
            stop = F.coalesce(F.array_min(ends), F.length(c) + F.lit(1))
            return strip_ws(F.substr(c, s["at"], stop - s["at"]))

        found = F.transform(spots, lambda s: F.struct(F.initcap(s["word"]).alias(label), cut(s).alias("forecast")))
        return F.filter(found, lambda s: F.length(s["forecast"]) > F.length(s[label]) + extra)

    return let(present, cuts)
