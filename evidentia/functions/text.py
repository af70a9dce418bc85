"""Text matching as native column expressions.

Offsets are code points, 0-based, ends exclusive.  Positions come from prefix
lengths, never from UTF-16 offsets.  All functions return null for null input
unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONFUSABLE, MIN_FUZZY_WORD, PLACEHOLDERS

ALNUM = r"[\p{L}\p{N}]"
WORD = rf"{ALNUM}+"


def quoted(needle: Column) -> Column:
    """A regular expression that matches the needle literally."""
    return F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def is_placeholder(value: Column) -> Column:
    return F.lower(stripped(value)).isin(PLACEHOLDERS)


def first_group(text: Column, pattern: Column) -> Column:
    """First group of a pattern that is itself a column; '' without a match."""
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_word(text: Column, needle: Column) -> Column:
    """Start of the first occurrence of the needle with word boundaries, or null.

    ``contains`` screens out most pairs before a pattern is compiled.
    """
    bounded = F.concat(F.lit(rf"(?<!{ALNUM})"), quoted(needle), F.lit(rf"(?!{ALNUM})"))
    place = let(bounded, lambda b: F.when(F.regexp_like(text, b), F.length(first_group(text, F.concat(F.lit("(?s)^(.*?)"), b)))))
    return F.when((F.length(needle) > 0) & F.contains(text, needle), place)


def _span(start: Column, length: Column) -> Column:
    return let(start, lambda at: F.when(at.isNotNull(), F.struct(at.alias("start"), (at + length).alias("end"))))


def span_exact(text: Column, needle: Column) -> Column:
    return _span(find_word(text, needle), F.length(needle))


def span_ignoring_case(text: Column, needle: Column) -> Column:
    return _span(find_word(F.lower(text), F.lower(needle)), F.length(needle))


def tokens(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def one_confusable_swap(a: Column, b: Column) -> Column:
    """Equal but for one character, which is a look-alike (l, i and 1; o and 0); case is ignored."""
    x, y = F.lower(a), F.lower(b)
    differ = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(p == q, 0).otherwise(1)), F.lit(0), lambda s, d: s + d)
    same_shape = F.translate(x, *CONFUSABLE) == F.translate(y, *CONFUSABLE)
    return F.when((F.length(a) == F.length(b)) & same_shape, differ == 1).otherwise(F.lit(False))


def distance_budget(length: Column) -> Column:
    return F.when(length < 8, 1).when(length < 14, 2).otherwise(3)


def words_fuzzy_equal(a: Column, b: Column) -> Column:
    """Whether two words may be one spelling: equal, one look-alike, or near with the same digits."""
    x, y = F.lower(a), F.lower(b)
    digits = lambda w: F.regexp_extract_all(w, F.lit(r"([0-9]+)"), F.lit(1))
    any_digit = x.rlike("[0-9]") | y.rlike("[0-9]")
    shorter = F.least(F.length(a), F.length(b))
    budget = F.when(any_digit, 1).otherwise(distance_budget(shorter))
    return (
        F.when(x == y, True)
        .when(one_confusable_swap(a, b), True)
        .when(any_digit & (digits(x) != digits(y)), False)
        .when(shorter < MIN_FUZZY_WORD, False)
        .when(F.abs(F.length(a) - F.length(b)) > 3, False)
        .otherwise(F.levenshtein(x, y) <= budget)
    )


def attribute_name(name: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), F.lit(" "), F.lit("_"))


def field_name(name: Column) -> Column:
    """Lower case without hyphens, slashes, bars, underscores, full stops and white space."""
    return F.regexp_replace(F.lower(name), r"[-/|_.\s]", "")


def shard_of(key: Column, n: int) -> Column:
    """A stable shard number: CRC-32 of the UTF-8 bytes modulo ``n``."""
    return (F.crc32(key.cast("binary")) % n).cast("int")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage rounded to the nearest, a half to the even digit; null if the whole is 0."""
    return F.bround(F.try_divide(F.lit(100.0) * part, whole), digits)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def bold_span(text: Column, start: Column, end: Column) -> Column:
    """HTML of a text with one span in bold."""
    before, inside, after = F.substring(text, F.lit(1), start), F.substring(text, start + 1, end - start), F.substring(text, end + 1, F.length(text))
    return F.concat(escaped(before), F.lit("<b>"), escaped(inside), F.lit("</b>"), escaped(after))


def one_word_denial(text: Column) -> Column:
    """Whether the whole text is "no" with five or more lower-case letters behind it."""
    return F.coalesce(text.rlike(r"\A[Nn]o[a-z]{5,}\z"), F.lit(False))


def phrase_span(text: Column, phrase: Column) -> Column:
    """First place of a phrase, else ignoring case, else an empty span at 0."""
    at = F.coalesce(F.nullif(F.instr(text, phrase), F.lit(0)), F.nullif(F.instr(F.lower(text), F.lower(phrase)), F.lit(0)))
    return F.when(at.isNotNull(), F.struct((at - 1).alias("start"), (at - 1 + F.length(phrase)).alias("end"))).otherwise(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
