"""Credentials in texts: named secrets, and parts that only together make one.

Base secrets (values assigned to a telling name, access identifiers, long hex
runs) are found in the text as it is.  Credentials also come in parts, each of
which alone proves nothing: an identifier (a client, user or key id), a secret
without a name (a random-looking token) and an endpoint (a URL or host).  These
weak parts are candidates.  A scope is a stretch of lines without a blank line
between them; parts of one scope are linked if the intervals around them, grown
by ``REACH`` characters, meet.  A weak candidate is reported if it is linked to
a base part of another role (access: identifier, assign: secret), or to parts
of both other roles.  Hex runs are secrets, but no proof of one.

The parts of a batch of documents lie on one line, documents one after another.
Intervals of one kind never overlap, so the interval join of two kinds is one
binary search for each candidate: linear memory, no pairs.

Defined cases: a null text is an empty one; spans count code points, ends
exclusive, names included; a failing base match is dropped without a retry; a
candidate that overlaps a base span is no candidate; of overlapping candidates
the earlier kind stays; rows that repeat an id are scanned each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
KINDS = (*BASE, *WEAK)
#: The role of each kind: 0 identifier, 1 secret, 2 endpoint.
ROLE = {"assign": 1, "access": 0, "hex": 1, "identifier": 0, "secret": 1, "endpoint": 2}
PROOF = ("assign", "access")
REACH, LEAST_BITS = 300, 3.5

_IS = r"""["']?\x20*+[:=]\x20*+["']?"""
ASSIGN = re.compile(rf"(password|passwd|secret|token|api_?key){_IS}([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile("AKIA[A-Z0-9]++")
HEX = re.compile("(?<![0-9a-f])[0-9a-f]{24,}+")
_HEX_BYTES = bytes(0x68 if c in b"0123456789abcdef" else 0x20 for c in range(256))

#: Names of this operator's own choice.
_ID_WORDS = ("client", "user", "login", "account", "key")
IDENTIFIER = re.compile(rf"(?<![A-Za-z0-9])(?:(?:client|account|access_?key|key|user)_?id|user(?:_?name)?|login|account){_IS}([A-Za-z0-9][A-Za-z0-9@._+-]{{2,}}+)", re.I | re.A)
_HOST_WORDS = ("host", "endpoint", "server", "url")
HOST = re.compile(rf"(?<![A-Za-z0-9])(?:host(?:_?name)?|endpoint|server|(?:base_?)?url){_IS}([A-Za-z0-9][A-Za-z0-9.-]*+(?::[0-9]{{1,5}})?)", re.I | re.A)
#: A scheme of at most 16 characters, and a login before the host if there is one.
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,15}://(?:([^\s\"'<>@/:]++)(?::([^\s\"'<>@/]*+))?@)?([^\s\"'<>@]++)", re.A)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+", re.A)
_BLANK = re.compile(r"\n[ \t\r]*+\n")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base secrets by start, then kind; each pattern only runs where it can match."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_BYTES):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _random_looking(token: str) -> bool:
    """Three kinds of characters, and as many bits a character as a random string has."""
    kinds = sum((any(c.islower() for c in token), any(c.isupper() for c in token), any(c.isdigit() for c in token)))
    if kinds < 3:
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) >= LEAST_BITS


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Weak parts, by kind and start, that overlap neither a base span nor a part of an earlier kind."""
    low = text.lower()
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in WEAK}
    if any(w in low for w in _ID_WORDS):
        found["identifier"] += [m.span() for m in IDENTIFIER.finditer(text)]
    if "://" in text:
        for m in URL.finditer(text):
            found["endpoint"].append(m.span(3))
            if m[1]:
                found["identifier"].append(m.span(1))
            if m[2]:
                found["secret"].append(m.span(2))
    if any(w in low for w in _HOST_WORDS):
        found["endpoint"] += [m.span() for m in HOST.finditer(text)]
    proof = {k for k, _, _ in base}
    if "access" in proof or (found["identifier"] and found["endpoint"]):  # else no token without a name is reported
        found["secret"] += [m.span() for m in TOKEN.finditer(text) if _random_looking(m[0].rstrip("="))]
    if not any(found.values()):
        return []
    taken = sorted((a, b) for _, a, b in base)
    out: list[Span] = []
    for kind in WEAK:
        free, upto = [], -1
        starts, furthest = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken] or [-1])
        for a, b in sorted(set(found[kind])):
            i = bisect_left(starts, b) - 1  # the last taken run that begins before the end
            if a < b and a >= upto and (i < 0 or furthest[i] <= a):
                free.append((a, b))
                upto = b
        out += [(kind, a, b) for a, b in free]
        taken = sorted(taken + free)
    return out


def _partner(a: np.ndarray, b: np.ndarray, scope: np.ndarray, starts: np.ndarray, ends: np.ndarray, scopes: np.ndarray) -> np.ndarray:
    """For each candidate the last interval of a kind that begins before its grown end, if it meets the candidate; else -1."""
    if not len(starts):
        return np.full(len(a), -1)
    last = np.searchsorted(starts, b + REACH) - 1
    at = np.maximum(last, 0)
    same = (last >= 0) & (scopes[at] == scope) & (ends[at] > a - REACH)
    if not same.all():  # an interval of a later scope may hide the scope's own last one
        edge = np.searchsorted(scopes, scope, "right") - 1
        low = np.minimum(last, edge)
        at = np.maximum(low, 0)
        same = (low >= 0) & (scopes[at] == scope) & (ends[at] > a - REACH)
    return np.where(same, at, -1)


def linked(texts: list[str], base: list[list[Span]]) -> list[list[tuple[Span, Span, Span | None]]]:
    """For each text, its reported weak parts with one or two linked parts: the interval join over all texts at once."""
    out: list[list[tuple[Span, Span, Span | None]]] = [[] for _ in texts]
    parts: dict[str, list[tuple[int, int, int, int]]] = {k: [] for k in KINDS}  # scope, start, end, text
    begin, scope = 0, 0
    begins = []
    for i, text in enumerate(texts):
        begins.append(begin)
        weak = candidates(text, base[i])
        if weak:
            blanks = np.array([m.end() for m in _BLANK.finditer(text)], np.int64)
            for kind, a, b in sorted([*base[i], *weak], key=lambda s: s[1]):
                parts[kind].append((scope + int(np.searchsorted(blanks, a, "right")), begin + a, begin + b, i))
            scope += len(blanks) + 1
        begin += len(text) + 1
    rows = {k: np.array(v, np.int64).reshape(-1, 4) for k, v in parts.items()}
    for kind in WEAK:
        mine = rows[kind]
        if not len(mine):
            continue
        proof = np.full((len(mine), 2), -1)
        other: dict[int, np.ndarray] = {}
        for k in KINDS:
            if ROLE[k] == ROLE[kind]:
                continue
            at = _partner(mine[:, 1], mine[:, 2], mine[:, 0], rows[k][:, 1], rows[k][:, 2], rows[k][:, 0])
            pick = np.stack([np.full(len(at), KINDS.index(k)), at], 1)
            if k in PROOF:
                proof = np.where((at >= 0)[:, None] & (proof[:, 1:] < 0), pick, proof)
            held = other.get(ROLE[k], np.full((len(mine), 2), -1))
            other[ROLE[k]] = np.where((at >= 0)[:, None] & (held[:, 1:] < 0), pick, held)
        one, two = other.values()
        for j in np.flatnonzero((proof[:, 1] >= 0) | ((one[:, 1] >= 0) & (two[:, 1] >= 0))):
            i = int(mine[j, 3])

            def span(pick: np.ndarray, i: int = i) -> Span:
                _, a, b, _ = rows[KINDS[pick[0]]][pick[1]]
                return (KINDS[pick[0]], int(a) - begins[i], int(b) - begins[i])

            me = (kind, int(mine[j, 1]) - begins[i], int(mine[j, 2]) - begins[i])
            out[i].append((me, span(proof[j]), None) if proof[j, 1] >= 0 else (me, span(one[j]), span(two[j])))
    return out


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redact(text: str, found: list[Span]) -> str:
    """The text with every union of overlapping spans replaced by the kind of its first one."""
    at, out = 0, []
    for kind, a, b in sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document (and the redacted text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"])
            base = [base_spans(t) for t in texts]
            more = [[m for m, _, _ in found] for found in linked(texts, base)]
            out = {"doc_id": pdf["doc_id"].astype("Int64")}
            out |= {f"n_{k}": np.array([sum(s[0] == k for s in b) for b in base], np.int64) for k in BASE}
            out["base_sha256"] = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            out["spans"] = [written([*b, *m]) for b, m in zip(base, more, strict=True)]
            out["n_linked"] = np.array([len(m) for m in more], np.int64)
            if with_text:
                out["redacted"] = [redact(t, [*b, *m]) for t, b, m in zip(texts, base, more, strict=True)]
            yield pd.DataFrame(out)

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return _texts(docs, doc_id, text).mapInPandas(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_linked long" + ", redacted string" * with_text)


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every reported span: where it is, whether it is weak, and the parts it was linked to as ``kind:start:end``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf["text"])
            base = [base_spans(t) for t in texts]
            rows = []
            for i, (spans, more) in enumerate(zip(base, linked(texts, base), strict=True)):
                rows += [(i, *s, False, "", "") for s in spans]
                rows += [(i, *s, True, written([x]), written([y]) if y else "") for s, x, y in more]
            out = pd.DataFrame(rows, columns=["doc_id", "kind", "start", "end", "weak", "link", "second_link"])
            out["doc_id"] = pdf["doc_id"].astype("Int64").take(out["doc_id"].to_numpy(np.int64)).to_numpy()
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return _texts(docs, doc_id, text).mapInPandas(run, "doc_id long, kind string, start long, end long, weak boolean, link string, second_link string")


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
