"""Rules on entity names as a table: each has a reason and a condition, and the first that a name breaks is its reason.

A condition is data (a bound, a pattern, words), so that a caller can add or
leave out rules; ``first_broken`` compiles them to one expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.functions.text import col, core_name, strip


@dataclass(frozen=True)
class Rule:
    """``of`` is the name as it stands (``name``), without bracketed notes (``core``), or the notes (``notes``); Latin rules only see ASCII names."""

    reason: str
    kind: str  # shorter, longer, matches, lacks, among, stutters
    value: object = None
    of: str = "name"
    latin: bool | None = None


#: Names that say nothing by themselves; this library's own choice.
GENERIC = [
    "analysis", "approach", "background", "benefit", "challenge", "comparison", "concept", "conclusion", "connection", "contribution", "development", "discovery", "education", "history", "idea", "impact",
    "importance", "influence", "introduction", "issue", "management", "method", "overview", "performance", "principle", "problem", "process", "quality", "relationship", "research", "result", "role", "security",
    "solution", "status", "strategy", "study", "summary", "testing", "方法", "问题", "研究", "分析", "影响", "意义", "过程", "结果", "背景", "概述", "总结", "发展", "设计", "管理", "目标", "特点",
]
#: Words of the machinery that a name shouldn't hold.
MACHINERY = "处理进度|系统状态|流水线|待处理|已完成|缓存|阈值"
RULES = (
    Rule("missing", "shorter", 1),
    Rule("too_short", "shorter", 2),
    Rule("too_long", "longer", 50, latin=True),
    Rule("too_long", "longer", 30, latin=False),
    Rule("no_letter", "lacks", r"\pL"),
    Rule("only_a_date", "matches", r"^[0-9]{4}年?([0-9]{1,2}月?([0-9]{1,2}日?)?)?$", "core"),
    Rule("machinery", "matches", MACHINERY),
    Rule("machinery", "matches", r"(?i) (token|api|llm|json)$|^(token|api|llm|json) |^(token|api|llm|json)$", "core", True),
    Rule("stutter", "stutters"),
    Rule("speech", "matches", "[曰道]：|说道|[哀痛惜壮]哉"),
    Rule("speech", "matches", "(?i)^(according to|(said|says|stated|claims|argues|believes|noted|mentioned) (that|\"))", latin=True),
    Rule("exclamation", "matches", "^.{4,}[!?！？]$"),
    Rule("list", "matches", "[、；]|,.*,.*,"),
    Rule("sentence", "matches", "。|^.*，.*$"),
    Rule("sentence", "matches", r"\. ", latin=True),
    Rule("phrase", "matches", "^.*的.*$", "long core"),
    Rule("identifier", "matches", "^[a-z][a-z0-9]*(_[a-z0-9]+)+$"),
    Rule("note_is_a_sentence", "matches", "[，。！？、；：]", "notes"),
    Rule("heading", "matches", "^(文件名|文档名|文档|文件|标题)[：:]"),
    Rule("question", "matches", "(?i)^(how|why|when|where|what|which|who) ", latin=True),
    Rule("vague", "matches", "(?i)^(the|an?) (best|most|main|key|important|major|new|latest|current|future) ", latin=True),
    Rule("activity", "matches", "(?i)^[a-z]{3,}ing (the|an?|of|and|with|for|our|your|its) ", latin=True),
    Rule("activity", "matches", "^(恢复|建立|推行|实施|加强|推进|促进|提高|改善|优化)..|(去世|病逝|争斗)$", "core"),
    Rule("generic", "among", GENERIC, "core"),
    Rule("aspect", "matches", "(?i)^(history|impact|role|study|analysis|overview|review|importance|future|evolution|development) of ", latin=True),
    Rule("aspect", "matches", "(?i) (overview|summary|introduction|conclusion|research|analysis|impact|legacy|improvement|optimization)$", latin=True),
)
NOTE = r"[（(]([^）)]+)[）)]"


def _stutters(text: Column) -> Column:
    """Whether the same two characters stand three times in a row."""
    places = F.when(F.length(text) >= 6, F.sequence(F.lit(1), F.length(text) - 5)).otherwise(F.array().cast("array<int>"))
    two = lambda i: F.substr(text, i, F.lit(2))
    return F.exists(places, lambda i: (two(i) == two(i + 2)) & (two(i) == two(i + 4)))


def first_broken(name: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """The reason of the first rule that a name breaks; null for a valid name."""
    n = strip(F.coalesce(col(name), F.lit("")))
    core = core_name(n)
    texts = {"name": n, "core": core, "long core": F.when(F.length(core) > 6, core).otherwise(""), "notes": F.array_join(F.regexp_extract_all(n, F.lit(NOTE), F.lit(1)), " ")}
    ascii_only = n.rlike(r"^[\x00-\x7F]*$")
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        text = texts[rule.of]
        if rule.kind == "shorter":
            broken = F.length(text) < rule.value
        elif rule.kind == "longer":
            broken = F.length(text) > rule.value
        elif rule.kind == "matches":
            broken = text.rlike(rule.value)
        elif rule.kind == "lacks":
            broken = ~text.rlike(rule.value)
        elif rule.kind == "among":
            broken = F.lower(text).isin(rule.value)
        else:
            broken = _stutters(text)
        if rule.latin is not None:
            broken = broken & (ascii_only if rule.latin else ~ascii_only)
        out = F.when(broken, rule.reason).otherwise(out)
    return out


def valid(name: Column | str) -> Column:
    return first_broken(name).isNull()
