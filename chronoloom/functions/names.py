"""Names, summaries and section documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.text import DEFAULT_SECTION, col, core_name, sections, strip

# Titles that may follow a person's name.
TITLE_SUFFIXES = [
    "教授", "博士", "先生", "女士", "同学", "老师", "工程师", "经理", "总监", "院长", "所长", "主任", "校长", "站长", "馆长", "主编", "首席", "总裁",
    "部长", "省长", "市长", "县长", "区长", "镇长", "村长", "将军", "上校", "中校", "少校", "大校", "司令", "参谋", "政委", "舰长", "机长",
]
BRACKETED = r"[（(][^）)]+[）)]"


def match_name(name: Column | str) -> Column:
    """The name that is compared: no bracketed notes, no title after it."""
    return strip(F.regexp_replace(core_name(name), f"(?:{'|'.join(TITLE_SUFFIXES)})$", ""))


def clean_name(name: Column | str) -> Column:
    """The name without a Latin alias after a slash, where the part before it has other letters."""
    n = strip(F.coalesce(col(name), F.lit("")))
    left, right = strip(F.substring_index(n, "/", 1)), strip(F.substring_index(n, "/", -1))
    alias = n.contains("/") & left.rlike(r"[\x{4e00}-\x{9fff}]") & right.rlike(r"^[\x00-\x7F]+$")
    return F.when(alias, left).otherwise(n)


def viable_name(name: Column | str) -> Column:
    """2 to 60 characters, one of them a letter."""
    n = strip(F.coalesce(col(name), F.lit("")))
    return F.length(n).between(2, 60) & n.rlike(r"\p{L}")


def summary(name: Column | str, content: Column | str) -> Column:
    """First line of the content that is no heading, 200 characters at most; else the name's first 100."""
    lines = F.transform(F.split(F.coalesce(col(content), F.lit("")), "\n"), strip)
    prose = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(F.substring(F.get(prose, 0), 1, 200), F.substring(col(name), 1, 100))


def wrap_section(text: Column | str, key: str = DEFAULT_SECTION) -> Column:
    """Plain text as a map of one section; blank text gives an empty map."""
    body = strip(F.coalesce(col(text), F.lit("")))
    return F.map_filter(F.create_map(F.lit(key), body), lambda _, v: v != "")


def content_sections(content: Column | str, kind: Column | str) -> Column:
    """Sections of Markdown content; other formats, and Markdown without sections, are one section."""
    parsed = sections(content)
    return F.when((F.coalesce(col(kind), F.lit("")) == "markdown") & (F.size(parsed) > 0), parsed).otherwise(wrap_section(content))


def render_sections(parts: Column | str, schema: list[str]) -> Column:
    """Markdown of a section map: the schema's keys in its order, then the others; empty sections are left out."""
    m = col(parts)
    known = F.array(*[F.lit(k) for k in schema]) if schema else F.array().cast("array<string>")
    keys = F.concat(known, F.array_except(F.map_keys(m), known))
    filled = F.filter(keys, lambda k: F.coalesce(F.element_at(m, k), F.lit("")) != "")
    return F.array_join(F.transform(filled, lambda k: F.concat(F.lit("## "), k, F.lit("\n"), F.element_at(m, k))), "\n\n")


def any_change(changes: Column | str) -> Column:
    """Whether a list of section changes holds a change."""
    return F.exists(col(changes), lambda c: c["change_type"] != "unchanged")


def grounded(name: Column | str, content: Column | str, source: Column | str) -> Column:
    """Whether the source or the content mentions the name or its core."""
    core, n = core_name(name), strip(col(name))
    text = F.concat_ws("\n", F.coalesce(col(source), F.lit("")), F.coalesce(col(content), F.lit("")))
    return text.contains(n) | ((core != "") & text.contains(core))


def intent(question: Column | str) -> Column:
    """Route of a question: path, traverse, timeline, statistics or search."""
    q = F.lower(F.coalesce(col(question), F.lit("")))
    return (
        F.when(q.rlike(r"\b(path|connect(s|ed|ion)?|link(s|ed)?)\b.*\b(between|to|and)\b"), "path")
        .when(q.rlike(r"\b(neighbou?rs?|related to|relations? of|around)\b"), "traverse")
        .when(q.rlike(r"\b(when|history|timeline|before|after|since)\b"), "timeline")
        .when(q.rlike(r"\b(how many|count|number of|statistics)\b"), "statistics")
        .otherwise("search")
    )
