"""Text and vector scalars as column expressions (JVM side)."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Section that holds text before the first heading (a fixed value of the data format).
DEFAULT_SECTION = "详细描述"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Text without white space at its ends."""
    return F.btrim(col(text), F.lit(" \t\n\r\x0b\x0c\u00a0\u3000"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def char_grams(text: Column, n: int) -> Column:
    """Distinct character n-grams; empty if the text is shorter."""
    size = F.length(text)
    return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))).otherwise(
        F.array().cast("array<string>")
    )


def characters(text: Column) -> Column:
    """Distinct characters."""
    return F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")


def _set_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def jaccard(left: Column | str, right: Column | str) -> Column:
    """Bigram-set similarity of trimmed lower-case texts; character sets where a text has no bigram."""
    a, b = (F.lower(strip(F.coalesce(col(x), F.lit("")))) for x in (left, right))
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return (
        F.when((a == "") | (b == ""), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(short, _set_jaccard(characters(a), characters(b)))
        .otherwise(_set_jaccard(char_grams(a, 2), char_grams(b, 2)))
    )


def bleu(left: Column | str, right: Column | str) -> Column:
    """Geometric mean of the shares of the left text's characters and bigrams that the right text has."""
    a, b = F.lower(col(left)), F.lower(col(right))
    part = lambda n: F.size(F.array_intersect(char_grams(a, n), char_grams(b, n))) / F.greatest(F.size(char_grams(a, n)), F.lit(1))
    return F.sqrt(part(1) * part(2))


def substring_bonus(left: Column | str, right: Column | str) -> Column:
    """Jaccard, or the ratio of lengths where one text holds the other, whichever is larger."""
    a, b = F.lower(strip(col(left))), F.lower(strip(col(right)))
    inside = (a.contains(b) | b.contains(a)) & (F.length(a) > 0) & (F.length(b) > 0)
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.greatest(jaccard(left, right), F.when(inside, ratio).otherwise(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratio of matching blocks (Ratcliff-Obershelp) of lower-case texts; no JVM function has it."""
    return pd.Series([difflib.SequenceMatcher(None, (a or "").lower(), (b or "").lower()).ratio() for a, b in zip(left, right, strict=True)])


def cosine(left: Column | str, right: Column | str) -> Column:
    """Cosine of two vectors with a floor of 1e-9 in the divisor; null vectors give zero."""
    a, b = col(left), col(right)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-9)), F.lit(0.0))


def doc_hash(text: Column | str) -> Column:
    return F.substring(F.md5(col(text).cast("binary")), 1, 12)


def section_hash(text: Column | str) -> Column:
    return F.substring(F.sha2(col(text).cast("binary"), 256), 1, 16)


def core_name(name: Column | str) -> Column:
    """The name without bracketed notes."""
    return strip(F.regexp_replace(col(name), r"[（(][^）)]+[）)]", ""))


def leading_name(name: Column | str) -> Column:
    """The name up to its first bracket, unless it starts with one."""
    n = strip(col(name))
    cut = strip(F.regexp_extract(n, r"^([^（(]+)[（(]", 1))
    return F.when(cut != "", cut).otherwise(n)


def token_estimate(text: Column | str) -> Column:
    """About one token for each CJK character and one for four others."""
    t = col(text)
    cjk = F.length(F.regexp_replace(t, r"[^一-鿿]", ""))
    return (cjk + F.ceil((F.length(t) - cjk) / 4)).cast("long")


def strip_fences(text: Column | str) -> Column:
    """Text without Markdown code fences."""
    t = F.regexp_replace(col(text), r"(?mi)^```[ \t]*[a-z]*[ \t]*\n?", "")
    return strip(F.regexp_replace(t, r"(?m)\n?```\s*$", ""))


def collapse_blank_lines(text: Column | str) -> Column:
    return strip(F.regexp_replace(col(text), r"\n{3,}", "\n\n"))


def clean_json(text: Column | str) -> Column:
    """Lenient JSON: no byte-order mark, ASCII punctuation, no trailing commas."""
    t = F.translate(F.regexp_replace(col(text), "^﻿", ""), "：，；", ":,;")
    return F.regexp_replace(t, r",\s*([}\]])", "$1")


def sections(content: Column | str) -> Column:
    """Markdown headings (levels 1 to 3) and their bodies; text before them has the default key, the last of equal titles counts."""
    text = F.coalesce(col(content), F.lit(""))
    marked = F.regexp_replace(text, r"(?m)^#{1,3}[ \t]+(.+)$", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001", -1)
    head = strip(parts[0])
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    pairs = F.transform(rest, lambda p: F.struct(strip(F.substring_index(p, "\u0002", 1)).alias("key"), strip(_after(p)).alias("value")))
    first = F.when(head != "", F.array(F.struct(F.lit(DEFAULT_SECTION).alias("key"), head.alias("value")))).otherwise(F.slice(pairs, 1, 0))
    every = F.concat(first, pairs)
    keys = F.array_distinct(F.transform(every, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(every, lambda e: e["key"] == k), -1)["value"]))


def _after(part: Column) -> Column:
    return F.substr(part, F.position(F.lit("\u0002"), part) + 1)


def section_changes(old: Column, new: Column) -> Column:
    """Rows of key, old, new and change type (added, removed, modified, unchanged) of two section maps."""
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    get = lambda m, k: F.element_at(m, k)

    def change(k: Column) -> Column:
        a, b = get(old, k), get(new, k)
        kind = (
            F.when(~F.map_contains_key(old, k), "added").when(~F.map_contains_key(new, k), "removed").when(strip(a) == strip(b), "unchanged").otherwise("modified")
        )
        return F.struct(k.alias("section_key"), F.coalesce(a, F.lit("")).alias("old"), F.coalesce(b, F.lit("")).alias("new"), kind.alias("change_type"))

    return F.transform(keys, change)


def snippet(text: Column | str, words: list[str], size: int = 200) -> Column:
    """Text from ``size`` before the first hit to ``size`` after the last one; the head where nothing hits."""
    t = col(text)
    low = F.lower(t)
    spots = F.filter(F.array(*[F.position(F.lit(w.lower()), low) for w in words]), lambda x: x > 0)
    start = F.greatest(F.array_min(spots) - size, F.lit(1))
    return F.when(F.size(spots) == 0, F.substring(t, 1, 2 * size)).otherwise(F.substr(t, start, F.array_max(spots) + size - start))
