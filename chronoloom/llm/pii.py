"""Personal data, also where it is disguised, with spans in the original text.

Base identifiers are found in the text as it is.  Then a transducer rewrites
disguises (homoglyphs, full-width forms, spelled digits, bracketed or spelled
"at" and "dot", zero-width characters) and keeps, for every character it
writes, the run of source characters it stands for.  Identifiers found in the
rewritten text are mapped back; those that rest on a rewritten character and
lie in no base span of their kind are added, also where they overlap one.
Whole texts are scanned, one row at a time.

Defined cases: a null text is an empty one; spans count code points, ends
exclusive; a failing match is dropped without a retry; rows that repeat an id
are scanned each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Possessive, and only from the start of a run of digits, where every leftmost match begins: linear in the text.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Letters of other scripts that look like ASCII ones, in pairs.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
#: Digits spelled in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_WORDS = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_OPEN, _CLOSE = r"[\(\[\{<]", r"[\)\]\}>]"
_B = r"(?<![ \t])[ \t]*+"
_AT = rf"(?:{_B}{_OPEN}[ \t]*(?:at|@|arroba|chez|bei)[ \t]*{_CLOSE}[ \t]*)"
_DOT = rf"(?:{_B}{_OPEN}[ \t]*(?:dot|\.|punto|point|punkt)[ \t]*{_CLOSE}[ \t]*)"
_BARE_AT, _BARE_DOT = r"(?:(?<![ \t])[ \t]++(?:at|@|arroba)[ \t]++)", r"(?:(?<![ \t])[ \t]++(?:dot|punto|point|punkt)[ \t]++)"
#: The parts of a disguised address: a "dot" or an "at" in brackets or bare, plain ones, and names between them.
_PART = re.compile(rf"(?P<at>{_AT}|(?<![ \t])[ \t]++@[ \t]++|@)|(?P<bare>{_BARE_AT})|(?P<dot>{_DOT}|{_BARE_DOT})|(?P<plain>\.)|(?P<name>[A-Za-z0-9%+_-]++)|(?P<end>[ \t]++|[^ \t])", re.I)
_SIGN = re.compile(rf"{_AT}|(?<![ \t])[ \t]++@[ \t]++|{_BARE_AT}|{_DOT}|{_BARE_DOT}", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]+")
_DOT_SIGN = re.compile(rf"{_DOT}|{_BARE_DOT}", re.I)
_DOTTED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|{_BARE_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: A stretch that an IP address, card or phone could fill once its digit words and spelled dots are rewritten.
_WORD_DIGIT = re.compile(rf"(?<!\w)(?:{_WORDS}|plus)(?!\w)", re.I)
_STRETCH = re.compile(rf"(?:[0-9+]|(?<!\w)(?:{_WORDS}|plus)(?!\w))(?:[0-9+().\s,-]|{_OPEN}[ \t]*(?:dot|\.|punto|point|punkt)[ \t]*{_CLOSE}|(?<!\w)(?:{_WORDS}|plus|dot|punto|point|punkt)(?!\w))*", re.I)
_DIGIT_TOKEN = re.compile(rf"(?<!\w)(plus)(?!\w)|(?<!\w)({_WORDS})(?!\w)|([0-9]+)|([\s,-]+)|(\w+|[^\w\s,-])", re.I)
_SPELLED_WORDS = (*DIGIT_WORDS, "plus")
#: An IP address holds at least this many digits, a card or phone more.
LEAST_DIGITS = 4
_BRACKETED = re.compile(rf"{_OPEN}[ \t]*(?:at|@|arroba|chez|bei|dot|\.|punto|point|punkt)[ \t]*{_CLOSE}", re.I)
_BARE = re.compile(_BARE_DOT, re.I)
_HIDDEN = frozenset("​‌‍⁠﻿­")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether digits, of any number, are at most 255."""
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and int(short) <= 255)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find(text: str) -> list[tuple[str, int, int]]:
    """Base identifiers, by kind and start; each pattern only runs where its rarest character stands."""
    out: list[tuple[str, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append(("email", m.start(), m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if any(d in text for d in "0123456789"):
        if "." in text:
            out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(m[0]) - sum(map(m[0].count, "+ ().-")) <= 15]
    return out


class Rewritten:
    """Text written so far, with the source run and a changed mark of every character."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int32)
        self.ends = self.starts + 1
        self.changed = np.zeros(len(text), bool)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Non-overlapping ascending edits ``(start, end, characters)`` of the current text."""
        parts, source, last, marks, at = [], [], [], [], 0
        for a, b, new in edits:
            parts += [self.text[at:a], new]
            n = len(new)
            source += [self.starts[at:a], np.full(n, self.starts[a])]
            last += [self.ends[at:a], np.full(n, self.ends[b - 1])]
            marks += [self.changed[at:a], np.ones(n, bool)]
            if not n:  # a deletion marks what stands before it
                before = next((m for m in reversed(marks) if len(m)), None)
                if before is not None:
                    before[-1] = True
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.starts, self.ends, self.changed = (np.concatenate([*x, old[at:]]) for x, old in ((source, self.starts), (last, self.ends), (marks, self.changed)))

    def glyphs(self, table: dict[str, str]) -> None:
        """Replace single characters by one or none each."""
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        to = points.copy()
        gone = np.zeros(len(points), bool)
        for c, new in table.items():
            here = points == ord(c)
            self.changed |= here
            if new:
                to[here] = ord(new)
            else:
                gone |= here
        before = np.flatnonzero(gone)
        before = before[before > 0] - 1
        stay = ~gone
        place = np.maximum.accumulate(np.where(stay, np.arange(len(points)), -1))
        marked = place[before]
        self.changed[marked[marked >= 0]] = True
        self.text = to[stay].tobytes().decode("utf-32-le", "surrogatepass")
        self.starts, self.ends, self.changed = self.starts[stay], self.ends[stay], self.changed[stay]


def _may_disguise(text: str) -> bool:
    """False if no part of a disguised "at" or "dot" stands in the text."""
    if any(c in text for c in "([{<") and _BRACKETED.search(text):
        return True
    if " @" in text or "\t@" in text:
        return True
    low = text.lower()
    return any(w in low for w in ("dot", "punto", "point", "punkt")) and _BARE.search(text) is not None


def _glyph(c: str) -> str | None:
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if c in _HIDDEN:
        return ""
    plain = unicodedata.normalize("NFKC", c)
    if plain != c and len(plain) == 1 and plain.isascii():
        return plain
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    return None


def deobfuscate(text: str) -> Rewritten | None:
    """The text with disguised signs, "at" and "dot" rewritten, or none if it has none."""
    out = None
    if not text.isascii():
        table = {c: g for c in set(text) if ord(c) > 127 and (g := _glyph(c)) is not None}
        if table:
            out = Rewritten(text)
            out.glyphs(table)
    now = out.text if out else text
    if _may_disguise(now):
        edits = _signs(now, [*_addresses(now), *(m.span() for m in _DOTTED_IP.finditer(now))])
        if edits:
            out = out or Rewritten(text)
            out.replace(edits)
    return out


def _addresses(text: str) -> list[tuple[int, int]]:
    """Stretches of disguised addresses, each grown from its "at" outwards over names and dots.

    A bracketed or plain "at" takes any dots after it, a bare one only spelled
    dots.  Every part is looked at once for the "at" on either side.
    """
    found, done = [], 0
    parts: list[tuple[str, int, int]] = []  # the chain of names and dots up to here
    ahead = _PART.finditer(text)
    part = next(ahead, None)
    while part:
        kind = part.lastgroup
        if kind not in ("at", "bare"):
            if kind == "end" or (kind == "name") == (bool(parts) and parts[-1][0] == "name") or (kind != "name" and not parts):
                parts = []
            if kind != "end" and (kind == "name" or parts):
                parts.append((kind, *part.span()))
            part = next(ahead, None)
            continue
        chain, parts = parts, []
        sign = kind
        part = next(ahead, None)
        after: list[tuple[str, int, int]] = []
        while part and part.lastgroup in ("name", "dot", "plain") and (part.lastgroup == "name") == (not after or after[-1][0] != "name"):
            if part.lastgroup == "plain" and sign == "bare":
                break
            after.append((part.lastgroup, *part.span()))
            part = next(ahead, None)
        parts = list(after)  # they may stand before another "at"
        if not chain or chain[-1][0] != "name" or chain[0][1] < done:
            continue
        end, dots = None, 0
        for k, a, b in after:
            if k == "name":
                host = _HOST.match(text, a, b)
                if not host:
                    break
                if dots:
                    end = host.end()
                if host.end() < b:
                    break
            else:
                dots += 1
        if end:
            found.append((chain[0][1], end))
            done = end
    return found


def _signs(text: str, stretches: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Edits of the disguised "at" and "dot" in some stretches."""
    spots = {}
    for start, end in stretches:
        for w in _SIGN.finditer(text, start, end):
            spots[w.start()] = (w.start(), w.end(), "." if _DOT_SIGN.fullmatch(w[0]) else "@")
    edits, last = [], 0
    for a in sorted(spots):
        if a >= last and text[a : spots[a][1]] != spots[a][2]:
            edits.append(spots[a])
            last = spots[a][1]
    return edits


def _digit_edits(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Edits that write digit words as digits, and the runs of single digits that they join.

    Between single digits of a run that holds a word, separators go; beside a
    longer group one blank stands for them.
    """
    tokens = [(m.lastindex, m.start(), m.end()) for m in _DIGIT_TOKEN.finditer(text)]
    tokens = [(2 if k == 3 and b - a == 1 else k, a, b) for k, a, b in tokens]
    edits, runs, i = [], [], 0
    while i < len(tokens):
        kind, a, b = tokens[i]
        following = [k for k, _, _ in tokens[i + 1 : i + 3]]
        if kind == 1 and following[:1] == [4] and following[1:] in ([2], [3]):
            edits += [(a, b, "+"), (tokens[i + 1][1], tokens[i + 1][2], "")]
            i += 2
            if following[1] == 3:
                continue
        elif kind != 2:
            if kind == 4 and b - a > 1 and i and tokens[i - 1][0] in (2, 3) and following[:1] in ([2], [3]):
                edits.append((a, b, " "))
            i += 1
            continue
        last = i
        while last + 2 < len(tokens) and tokens[last + 1][0] == 4 and tokens[last + 2][0] == 2:
            last += 2
        run = tokens[i : last + 1]
        if any(k == 2 and not text[x].isdigit() for k, x, _ in run):
            edits += [(x, y, "" if k == 4 else DIGIT_WORDS.get(text[x:y].lower(), text[x:y])) for k, x, y in run]
            runs.append((a, run[-1][2]))
        i = last + 1
    return [e for e in edits if text[e[0] : e[1]] != e[2]], runs


def _spelled(text: str) -> list[tuple[str, int, int]]:
    """Identifiers of digits in which a digit is spelled; each run of single digits is also read alone."""
    out: list[tuple[str, int, int]] = []

    def read(a: int, b: int, alone: bool) -> None:
        part = text[a:b]
        edits, runs = _digit_edits(part)
        if not edits:
            return
        new = Rewritten(part)
        new.replace(edits)
        new.replace(_signs(new.text, [m.span() for m in _DOTTED_IP.finditer(new.text)]))
        for kind, x, y in find(new.text):
            if new.changed[x:y].any():
                out.append((kind, a + int(new.starts[x]), a + int(new.ends[x:y].max())))
        for x, y in runs if not alone else ():
            if (x, y) != (0, len(part)):
                read(a + x, a + y, True)

    low = text.lower()
    if any(w in low for w in _SPELLED_WORDS) and _WORD_DIGIT.search(text):
        for m in _STRETCH.finditer(text):
            words = sum(1 for _ in _WORD_DIGIT.finditer(m[0]))
            if words and words + len(_digits(m[0])) >= LEAST_DIGITS:
                read(m.start(), m.end(), False)
    return out


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans with those that only show after rewriting."""
    text = text or ""
    base = find(text)
    new = deobfuscate(text)
    spelled = _spelled(new.text if new else text)
    if new is None and not spelled:
        return base, base
    more: list[tuple[str, int, int]] = []
    for kind, a, b in find(new.text) if new else ():
        if new.changed[a:b].any():
            more.append((kind, int(new.starts[a]), int(new.ends[a:b].max())))
    for kind, a, b in spelled:
        more.append((kind, int(new.starts[a]), int(new.ends[a:b].max())) if new else (kind, a, b))
    return base, _with_new(base, more)


def _with_new(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and those new ones that lie in no other span of their kind, by kind and start."""
    out, last, upto = [], "", -1
    for _, a, back, is_new, kind in sorted([(KINDS.index(k), a, -b, False, k) for k, a, b in base] + [(KINDS.index(k), a, -b, True, k) for k, a, b in more]):
        if kind != last:
            last, upto = kind, -1
        if not is_new or -back > upto:
            out.append((kind, a, -back))
        upto = max(upto, -back)
    return out


def written(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None) -> str:
    """The text with every union of overlapping spans replaced by the kind of its longest span."""
    text, runs = text or "", []
    for kind, a, b in sorted(spans(text)[1], key=lambda x: (x[1], -x[2])):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
            runs[-1][2] = max(runs[-1][2], (b - a, kind), key=lambda x: x[0])
        else:
            runs.append([a, b, (b - a, kind)])
    at, out = 0, []
    for a, b, (_, kind) in runs:
        out += [text[at:a], f"<{kind}>"]
        at = b
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document (and the redacted text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [spans(t) for t in pdf["text"]]
            kinds = [[k for k, _, _ in base] for base, _ in both]
            out = {"doc_id": pdf["doc_id"].astype("Int64")}
            out |= {f"n_{k}": np.array([x.count(k) for x in kinds], np.int64) for k in KINDS}
            out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in both]
            out["spans"] = [written(more) for _, more in both]
            out["n_spans"] = np.array([len(more) for _, more in both], np.int64)
            if with_text:
                out["redacted"] = [redact(t) for t in pdf["text"]]
            yield pd.DataFrame(out)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInPandas(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_spans long" + ", redacted string" * with_text)
