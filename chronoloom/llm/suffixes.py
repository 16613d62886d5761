"""Suffix arrays by induced sorting, and repeated byte strings found with them.

Two lengths are looked for in one pass: strings of ``length`` bytes, which are
removed, and shorter ones of ``passage`` bytes, which are counted.  Every place
is owned by one anchor: the smallest hash of the ``ANCHOR``-byte windows in the
``passage`` bytes from there, the leftmost of equals.  That depends on those
bytes alone, so equal strings of either length have equal anchors.  Consecutive
places of one anchor, with ``length`` bytes from the last, form a context;
contexts go to shards by their anchor's hash, so all places of a string meet in
one shard.  Contexts that occur twice as a whole are settled before; one copy of
every other context enters its shard's text.

A shard sorts its suffixes by induced sorting (types, leftmost-smaller
substrings, names, the names' suffixes recursively, induction) in array
operations: over one bucket at a time for bytes, over as many places as don't
depend on each other for names.  Permuted common prefixes follow from the
irreducible ones, which are compared.  Neighbours in the array with a common
prefix of ``length`` (or ``passage``) bytes hold a repeated string.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing;
matches inside one text count, overlapping ones too; strings never cross texts;
rows that repeat an id are separate documents, which repeat each other; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import lanes, merge_runs, run_hashes
from chronoloom.llm.spans import collapse, keyed, marked
from chronoloom.plans.materialize import materialize

LENGTH, ANCHOR = 400, 64
#: Bytes of the shorter repeats that are counted but stay: 51 words of four letters and a blank.
PASSAGE = 255
#: Alphabets up to this size are induced bucket by bucket.
FEW_BUCKETS = 512
#: Never a byte of UTF-8, so no string of text holds it.
SEPARATOR = 0xFF
#: Bytes of context after which a shard is sorted, and beyond which one anchor's contexts are compared by hashes instead.
SHARD_BYTES, GROUP_BYTES = 3 << 20, 24 << 20


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the end counts as smallest."""
    n = len(s)
    differs = np.ones(n, bool)
    differs[:-1] = s[1:] != s[:-1]
    to = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = s[1:] > s[:-1]
    return smaller[to]


def _append(sa: np.ndarray, heads: np.ndarray, chars: np.ndarray, suffixes: np.ndarray, step: int) -> None:
    """Put suffixes at their buckets' pointers, keeping their order, and move the pointers by ``step``."""
    if not len(chars):
        return
    order = np.argsort(chars, kind="stable")
    c = chars[order].astype(np.int64)
    first = np.r_[True, c[1:] != c[:-1]]
    begin = np.flatnonzero(first)
    rank = np.arange(len(c)) - begin[np.cumsum(first) - 1]
    sa[heads[c] + step * rank] = suffixes[order]
    heads[c[begin]] += step * np.diff(np.r_[begin, len(c)])


def induce(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """Suffix array from an order of the leftmost-smaller suffixes (exact if that order is)."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    tails = np.cumsum(counts)
    heads = tails - counts
    sa = np.full(n, -1, np.int64)
    if size > FEW_BUCKETS:
        return _induce_names(s, small, leftmost, sa, heads, tails)
    put = tails - 1
    _append(sa, put, s[leftmost[::-1]], leftmost[::-1], -1)
    left_tail = put + 1
    front = heads.copy()
    if not small[n - 1]:
        _append(sa, front, s[n - 1 : n], np.array([n - 1]), 1)
    for c in range(size):
        if not counts[c]:
            continue
        done = heads[c]
        while done < front[c]:
            now = sa[done : front[c]]
            done = front[c]
            before = now[now > 0] - 1
            before = before[~small[before]]
            if len(before):
                _append(sa, front, s[before], before, 1)
        now = sa[left_tail[c] : tails[c]]
        before = now[now > 0] - 1
        before = before[~small[before]]
        if len(before):
            _append(sa, front, s[before], before, 1)
    back = tails - 1
    for c in range(size - 1, -1, -1):
        if not counts[c]:
            continue
        done = tails[c] - 1
        while done > back[c]:
            now = sa[back[c] + 1 : done + 1][::-1]
            done = back[c]
            before = now[now > 0] - 1
            before = before[small[before]]
            if len(before):
                _append(sa, back, s[before], before, -1)
        now = sa[heads[c] : front[c]][::-1]
        before = now[now > 0] - 1
        before = before[small[before]]
        if len(before):
            _append(sa, back, s[before], before, -1)
    return sa


def _induce_names(s: np.ndarray, small: np.ndarray, leftmost: np.ndarray, sa: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The same induction where buckets are many and short: places are read in stretches that nothing is put into meanwhile."""
    n, places = len(s), np.arange(len(s))
    _append(sa, tails - 1, s[leftmost[::-1]], leftmost[::-1], -1)
    front = heads.copy()
    _append(sa, front, s[n - 1 : n], np.array([n - 1]), 1)
    for step, put, kind in ((1, front, False), (-1, tails - 1, True)):
        if step < 0:  # the smaller suffixes are put anew
            sa[small[sa] & (sa >= 0)] = -1
        at, wide = 0, 1024  # how many places were read
        while at < n:
            upto = min(n, at + wide)
            now = sa[at:upto] if step > 0 else sa[n - upto : n - at][::-1]
            read = (now > 0).nonzero()[0]
            before = now[read] - 1
            right = small[before] == kind
            read, before = read[right], before[right]
            if len(before):
                chars = s[before]
                order = chars.argsort(kind="stable")
                c = chars[order]
                spot = places[: len(c)]
                first = spot.copy()
                first[1:][c[1:] == c[:-1]] = 0  # where each bucket's run begins
                target = np.empty(len(c), np.int64)
                target[order] = put[c] + step * (spot - np.maximum.accumulate(first))
                nearest = int(target.min()) if step > 0 else n - 1 - int(target.max())
                if nearest < upto:  # what stands from there on waits for it
                    upto = nearest
                    ready = read < upto - at
                    before, chars, target = before[ready], chars[ready], target[ready]
                sa[target] = before
                np.add.at(put, chars, step)
            wide = max(256, 2 * (upto - at))
            at = upto
    return sa


def substring_names(s: np.ndarray, small: np.ndarray, spots: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost-smaller substrings at ``spots``, equal ones sharing a rank, and how many differ.

    Symbols are compared together with their suffix's type, so no substring is a
    prefix of another but the last, which ends the string and comes first.  As
    many symbols as fit into a word are compared at once; only what is still
    equal goes on, so all rounds together read each substring once.
    """
    n, m = len(s), len(spots)
    symbols = s.astype(np.int64) * 2 + small + 1
    length = np.append(spots[1:] + 1, n) - spots
    bits = (2 * size).bit_length()
    width = 63 // bits
    if bits <= 8:  # eight symbols are read as one word, the first in its highest byte
        width, lane = 8, lanes(np.r_[symbols.astype(np.uint8), np.zeros(8, np.uint8)]).view(">u8")
    rank, live, done = np.zeros(m, np.int64), np.arange(m), 0
    while len(live):
        at, left = spots[live] + done, length[live] - done
        if bits <= 8:
            cut = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
            key = np.where(left > 0, lane[at].astype(np.uint64) >> cut << cut, np.uint64(0))
        else:
            key = np.zeros(len(live), np.int64)
            for k in range(width):
                key = (key << bits) | np.where(k < left, symbols[np.minimum(at + k, n - 1)], 0)
        before = rank[live]
        order = np.lexsort((key, before)) if done else np.argsort(key)
        k, r, who = key[order], before[order], live[order]
        old = np.append(True, r[1:] != r[:-1])
        new = old | np.append(True, k[1:] != k[:-1])
        spot = np.arange(len(who))
        first = np.maximum.accumulate(np.where(new, spot, 0))
        rank[who] = r + first - np.maximum.accumulate(np.where(old, spot, 0))
        alone = new & np.append(new[1:], True)
        done += width
        live = who[~alone & ((length[who] > done) | (who == m - 1))]  # the last one may begin another and end just here
    taken = np.zeros(m, bool)
    taken[rank] = True
    dense = np.cumsum(taken)
    return dense[rank] - 1, int(dense[-1])


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of integers from zero; the names' suffixes are sorted by this function itself."""
    s = np.asarray(s)
    n = len(s)
    if n < 2:
        return np.arange(n)
    size = int(s.max()) + 1
    small = suffix_types(s)
    spots = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(spots) < 2:
        return induce(s, small, spots, size)
    names, different = substring_names(s, small, spots, size)
    ordered = spots[suffix_array(names) if different < len(spots) else np.argsort(names)]
    return induce(s, small, ordered, size)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int | None = None, restarts: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of every suffix with the one before it in the array, by text position.

    Compared directly only where the left neighbours differ; elsewhere it is one
    less than at the position before.  ``most`` bounds what is compared at once;
    positions in ``restarts`` are compared anew, so that the bound only cuts
    prefixes of more than ``most`` symbols after the last of them.
    """
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    most = n if most is None else most
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    chars = np.asarray(s, np.uint8)
    direct = (before <= 0) | (place == 0)
    direct[1:] |= chars[:-1] != chars[np.maximum(before[1:] - 1, 0)]
    if restarts is not None:
        direct[restarts] = True
    lane = lanes(np.r_[chars, np.zeros(8, np.uint8)])
    at = np.flatnonzero(direct & (before >= 0))
    a, b = at, before[at]
    found = np.zeros(n, np.int64)
    go = np.arange(len(at))
    length = np.zeros(len(at), np.int64)
    limit = n - np.maximum(a, b)
    done = 0
    while len(go) and done < most:
        odd = lane[a] ^ lane[b]
        low = odd & (~odd + np.uint64(1))  # the lowest bit that differs
        ends = odd != 0
        length[go[ends]] = done + ((np.frexp(low[ends].astype(np.float64))[1] - 1) >> 3)
        done += 8
        on = ~ends & (np.maximum(a, b) + 8 <= n)
        length[go[~ends & ~on]] = done
        go, a, b = go[on], a[on] + 8, b[on] + 8
    length[go] = done
    found[at] = np.minimum(length, limit)
    source = np.maximum.accumulate(np.where(direct, place, 0))
    return np.maximum(found[source] - (place - source), 0)


def anchor_rows(docs: DataFrame, length: int, passage: int, anchor: int) -> DataFrame:
    """``kind`` 0: the context ``a``..``e`` of an anchor that owns places ``a``..``b``; ``kind`` 1: one known to be repeated."""
    reach = passage - anchor + 1
    segment = 1_000_000
    place_bits = np.uint64((1 << 20) - 1)

    def cut(key: int, body: bytes) -> Iterator[tuple[int, int, bytes, int]]:
        """Pieces with the number of places they own; the last one owns all it has."""
        for at in range(0, max(1, len(body) - length + 1), segment - length):
            piece = body[at : at + segment - 1]
            if len(piece) >= passage:
                yield key, at, piece, len(piece) - passage + 1 if at + len(piece) == len(body) else segment - length

    def rows(parts: list[tuple[int, int, bytes, int]]) -> Iterator[pd.DataFrame]:
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        sizes = np.array([len(p[2]) for p in parts])
        first = np.cumsum(sizes) - sizes
        n = len(data)
        at = np.arange(n - anchor + 1)
        low = (run_hashes(data, at, at + anchor) & ~place_bits) | at.astype(np.uint64)
        step = 1
        while step * 2 <= reach:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        rest = reach - step
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        owner = (low & place_bits).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(owner)]
        own = np.arange(len(owner)) - first[part] < np.array([p[3] for p in parts])[part]
        begin = np.flatnonzero(own & np.r_[True, (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])])
        inside = np.cumsum(own)
        stop = np.r_[begin[1:], len(owner)]
        stop = begin + (inside[stop - 1] - inside[begin])  # the last place that is owned
        p, who = owner[begin], part[begin]
        end = np.minimum(stop + length, (first + sizes)[who])
        ah = run_hashes(data, p, p + anchor)
        ch = run_hashes(data, begin, end) ^ (p - begin).astype(np.uint64)
        keys = np.array([x[0] for x in parts], np.int64)[who]
        shift = np.array([x[1] for x in parts], np.int64)[who] - first[who]
        lead, again = collapse(ah, ch)
        a, b, e = ((x + shift).astype(np.int64) for x in (begin, stop, end))
        yield pd.DataFrame({"kind": 1, "ah": keys[again], "ch": 0, "key": keys[again], "a": a[again], "b": b[again], "e": e[again]})
        yield pd.DataFrame({"kind": 0, "ah": ah[lead].view(np.int64), "ch": ch[lead].view(np.int64), "key": keys[lead], "a": a[lead], "b": b[lead], "e": e[lead]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for key, body in zip(pdf["key"].tolist(), pdf["body"], strict=True):
                for piece in cut(key, body):
                    if size + len(piece[2]) >= segment and held:
                        yield from rows(held)
                        held, size = [], 0
                    held.append(piece)
                    size += len(piece[2])
            if held:
                yield from rows(held)

    return docs.select("key", "body").mapInPandas(run, "kind int, ah long, ch long, key long, a long, b long, e long")


def context_rows(wanted: DataFrame) -> DataFrame:
    """The bytes of the open contexts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def frame() -> pd.DataFrame:
            columns = [np.concatenate([h[i] for h in held]) for i in range(4)]
            return pd.DataFrame(dict(zip(("ah", "key", "a", "places"), columns, strict=True)) | {"context": [c for h in held for c in h[4]]})

        for pdf in batches:
            for key, body, ah, a, b, e in zip(pdf["key"].tolist(), pdf["body"], pdf["ah"], pdf["a"], pdf["b"], pdf["e"], strict=True):
                for at in range(0, len(ah), 4096):
                    first, stop = a[at : at + 4096], e[at : at + 4096]
                    out = [ah[at : at + 4096], np.full(len(first), key), first, b[at : at + 4096] - first + 1, [body[x:y] for x, y in zip(first.tolist(), stop.tolist(), strict=True)]]
                    held.append(out)
                    size += len(first)
                    if size >= 4096:
                        yield frame()
                        held, size = [], 0
            if held:
                yield frame()
                held, size = [], 0

    return wanted.mapInPandas(run, "ah long, key long, a long, places long, context binary")


def repeated_starts(contexts: list[bytes], places: list[int], lengths: tuple[int, ...]) -> list[tuple[np.ndarray, ...]]:
    """Of each context, for each length, the offsets among its first ``places`` whose strings start elsewhere too.

    Neighbouring contexts overlap after the places that they own, so only owned
    places count: a run of the array with common prefixes of the length must
    hold two of them.
    """
    parts: list[bytes] = []
    for c in contexts:
        parts += [c, bytes([SEPARATOR])]
    data = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    first = np.cumsum(sizes + 1) - sizes - 1
    values = np.unique(data)
    dense = np.searchsorted(values, data).astype(np.uint8)
    sa = suffix_array(dense)
    near = permuted_prefixes(dense, sa, int(sizes.max()) + 8, first)
    near = near[sa]
    limit = np.array(places)
    found = []
    for length in lengths:
        link = near >= length
        member = link.copy()
        member[:-1] |= link[1:]
        at = np.flatnonzero(member)  # only these share a prefix of the length with a neighbour
        run, p = np.cumsum(~link[at]), sa[at]
        which = np.searchsorted(first, p, "right") - 1
        offset = p - first[which]
        mine = (offset < limit[which]) & (sizes[which] - offset >= length)
        spots = np.sort(p[mine & (np.bincount(run[mine], minlength=len(at) + 2)[run] > 1)])
        cuts = np.searchsorted(spots, np.r_[first, len(data)])
        found.append([spots[cuts[i] : cuts[i + 1]] - first[i] for i in range(len(contexts))])
    return list(zip(*found, strict=True))


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered runs of ascending string starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + length).tolist(), strict=True))


def shard_rows(contexts: DataFrame, lengths: tuple[int, int], shard_bytes: int, group_bytes: int) -> DataFrame:
    """``kind`` 1: covered runs from the shards' arrays; ``kind`` 0: string hashes of an anchor too crowded for a shard."""
    schema = "kind int, w1 long, w2 long, key long, a long, b long, size int"

    def sort(held: list[tuple[pd.DataFrame, int, int]]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([p.iloc[lo:hi] for p, lo, hi in held], ignore_index=True)
        out = []
        for key, a, found in zip(pdf["key"].tolist(), pdf["a"].tolist(), repeated_starts(pdf["context"].tolist(), pdf["places"].tolist(), lengths), strict=True):
            for size, starts in zip(lengths, found, strict=True):
                out += [(1, key, 0, key, a + x, a + y, size) for x, y in _runs(starts, size)]
        if out:
            yield pd.DataFrame(out, columns=["kind", "w1", "w2", "key", "a", "b", "size"])

    def spill(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for key, a, n, c in zip(pdf["key"].tolist(), pdf["a"].tolist(), pdf["places"].tolist(), pdf["context"], strict=True):
            data = np.frombuffer(c, np.uint8)
            for size in lengths:
                at = np.arange(min(n, max(0, len(data) - size + 1)))
                w1 = run_hashes(data, at, at + size)
                w2 = run_hashes(data[::-1].copy(), len(data) - at - size, len(data) - at)
                yield pd.DataFrame({"kind": 0, "w1": w1.view(np.int64), "w2": w2.view(np.int64), "key": key, "a": a + at, "b": a + at + size, "size": size})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, tail, tail_size, last, crowded = [], 0, [], 0, None, None
        for pdf in batches:  # sorted by anchor: whole anchors are gathered until a shard is full
            ah = pdf["ah"].to_numpy(np.int64)
            if not len(ah):
                continue
            cut = np.flatnonzero(np.r_[True, ah[1:] != ah[:-1]])
            sums = np.add.reduceat(np.fromiter(map(len, pdf["context"]), np.int64, len(ah)), cut)
            for this, lo, hi, weight in zip(ah[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(ah)], sums.tolist(), strict=True):
                if crowded == this:
                    yield from spill(pdf.iloc[lo:hi])
                    continue
                if tail and last != this:
                    for own in tail:
                        if held and held[-1][0] is own[0] and held[-1][2] == own[1]:
                            own = (own[0], held.pop()[1], own[2])
                        held.append(own)
                    size += tail_size
                    tail, tail_size = [], 0
                    if size >= shard_bytes:
                        yield from sort(held)
                        held, size = [], 0
                last = this
                tail.append((pdf, lo, hi))
                tail_size += weight
                if tail_size > group_bytes:
                    crowded = this
                    for p, lo, hi in tail:
                        yield from spill(p.iloc[lo:hi])
                    tail, tail_size = [], 0
        if held or tail:
            yield from sort(held + tail)

    return contexts.repartition("ah").sortWithinPartitions("ah").mapInPandas(run, schema)


def covered_bytes(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``key``, ``a``, ``b``, ``size``: runs of bytes that lie in repeated strings of ``size`` bytes, one of the two lengths."""
    if not anchor <= passage < length:
        raise ValueError("an anchor must fit into a passage, and a passage be shorter than what is removed")
    found = anchor_rows(docs, length, passage, anchor)
    seen = marked(found.withColumn("ch", F.when(F.col("kind") == 0, F.col("ch"))))
    kept = materialize(seen.where("kind = 1 or settled or open").select("kind", "ah", "key", "a", "b", "e", "settled", "open"), "contexts")
    both = F.explode(F.array(F.struct((F.col("b") + F.lit(passage)).alias("b"), F.lit(passage).alias("size")), F.struct(F.col("e").alias("b"), F.lit(length).alias("size"))))
    runs = kept.where("kind = 1 or settled").select("key", "a", both.alias("r")).select("key", "a", "r.*").where("b - a >= size")
    opens = kept.where("kind = 0 and open").groupBy("key").agg(F.collect_list(F.struct("ah", "a", "b", "e")).alias("opens"))
    opens = opens.select("key", *(F.col(f"opens.{c}").alias(c) for c in ("ah", "a", "b", "e")))
    wanted = docs.select("key", "body").join(opens.hint("shuffle_hash"), "key")
    sharded = materialize(shard_rows(context_rows(wanted), (length, passage), shard_bytes, group_bytes), "shards")
    by = Window.partitionBy("w1").orderBy("w2")
    crowded = sharded.where("kind = 0").withColumn(
        "again", F.coalesce(F.lag("w2").over(by) == F.col("w2"), F.lit(False)) | F.coalesce(F.lead("w2").over(by) == F.col("w2"), F.lit(False))
    )
    columns = ["key", "a", "b", "size"]
    return runs.select(*columns).unionAll(sharded.where("kind = 1").select(*columns)).unionAll(crowded.where("again").select(*columns))


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, with_text: bool = False, doc_id: str = "doc_id", text: str = "text", **sizes) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``n_passage`` (and the kept bytes) of every document.

    ``n_passage`` counts the bytes in repeated strings of ``passage`` bytes, which stay where they are shorter than ``length``.
    """
    rows = keyed(docs, doc_id, text)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, body, s, e, z in zip(pdf["doc_id"].astype("Int64"), pdf["body"], pdf["starts"], pdf["ends"], pdf["sizes"], strict=True):
                merged, short, parts, at = [], 0, [], 0
                if s is not None:
                    merged = merge_runs(s[z == length], e[z == length])
                    short = sum(b - a for a, b in merge_runs(s, e))
                for a, b in merged:
                    parts.append(body[at:a])
                    at = b
                kept = b"".join([*parts, body[at:]])
                out.append((d, len(body), len(body) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), short, *([kept] * with_text)))
            got = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage", *["kept"] * with_text])
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long" + ", kept binary" * with_text
    runs = covered_bytes(rows, length, passage, **sizes).groupBy("key").agg(F.collect_list(F.struct("a", "b", "size")).alias("r"))
    runs = runs.select("key", F.col("r.a").alias("starts"), F.col("r.b").alias("ends"), F.col("r.size").alias("sizes"))
    whole = rows.join(runs.hint("shuffle_hash"), "key", "left")  # the narrow side is hashed, so the texts aren't sorted
    return whole.select("doc_id", "body", "starts", "ends", "sizes").mapInPandas(cut, schema)


def _covered_sql(size: int) -> str:
    """Places of repeated strings of ``size`` bytes and the runs that they cover, over hexadecimal bodies."""
    return f"""
w{size} AS (SELECT k, i, md5(substr(h, 2 * i + 1, {2 * size})) AS m FROM (SELECT k, h, unnest(range(0, n - {size} + 1)) AS i FROM bodies WHERE n >= {size})),
t{size} AS (SELECT k, i FROM w{size} QUALIFY count(*) OVER (PARTITION BY m) > 1),
e{size} AS (SELECT k, i, CASE WHEN i - lag(i) OVER (PARTITION BY k ORDER BY i) <= {size} THEN 0 ELSE 1 END AS new FROM t{size}),
g{size} AS (SELECT k, i, sum(new) OVER (PARTITION BY k ORDER BY i) AS g FROM e{size}),
r{size} AS (SELECT k, min(i) AS a, max(i) + {size} AS b FROM g{size} GROUP BY k, g)"""


#: The same answer in SQL, over a table ``documents``.
ORACLE = f"""
WITH bodies AS (SELECT row_number() OVER () AS k, doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
{_covered_sql(LENGTH)}, {_covered_sql(PASSAGE)},
removed AS (SELECT k, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r{LENGTH} GROUP BY k),
gaps AS (SELECT k, b AS a, lead(a) OVER (PARTITION BY k ORDER BY a) AS z FROM r{LENGTH} UNION ALL SELECT k, 0, min(a) FROM r{LENGTH} GROUP BY k),
kept AS (SELECT k, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(z, n) - a)), '' ORDER BY a) AS h FROM gaps JOIN bodies USING (k) GROUP BY k),
short AS (SELECT k, sum(b - a)::BIGINT AS n_passage FROM r{PASSAGE} GROUP BY k)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept.h, bodies.h))) AS kept_sha256, coalesce(n_passage, 0)::BIGINT AS n_passage
FROM bodies LEFT JOIN removed USING (k) LEFT JOIN kept USING (k) LEFT JOIN short USING (k)"""
