"""Token ids in grammar-compressed shards (Re-Pair).

Documents are dealt by ranges of their id and encoded in ascending order; each
task writes shards of bounded size.  In a shard, frequent pairs of neighbouring
symbols are replaced by nonterminals, round by round: a round takes the most
frequent pairs that cannot overlap each other.  Rules only name symbols of
earlier rounds, and every rule's expansion length is stored, so any range of
ids is decoded from the nearest sampled offset without expanding the rest.

Defined cases: a null text is an empty one and holds the end id alone; rows
without an id come first; rows that repeat an id are all written, ordered by
text; an empty table gives no shards and no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import kept, lanes, open_fs, ragged_take, run_hashes, spread, tidy
from chronoloom.plans.materialize import materialize, new_folder

MAGIC = b"RPTOKEN1"
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: First nonterminal; symbols stay below 2**16, so a symbol takes two bytes.
BASE, LIMIT = 50_257, 1 << 16
#: Ids of one shard, symbols between sampled offsets, words that an encoder keeps.
SHARD_IDS, SAMPLE_EVERY, CACHE_WORDS = 2_000_000, 256, 800_000
#: Characters that are encoded at once.
PART_CHARS = 2_000_000
MANIFEST = "part int, seq int, path string, docs long, ids long, symbols long, rules long"


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Of a byte: 1 for an ASCII letter or digit, 2 for an ASCII mark other than an apostrophe, 4 for the lead byte of U+00C0 to U+00FF.
_KINDS = np.zeros(256, np.uint8)
_KINDS[0x21:0x7F] = 2
_KINDS[list(_LETTERS)] = 1
_KINDS[ord("'")] = 0
_KINDS[0xC3] = 4


def inner_cuts(data: np.ndarray) -> np.ndarray:
    """Where a byte-level pre-tokenizer surely begins a new piece inside a space-led one.

    Between a letter or digit and a mark, before a line's end, and after one
    that stands alone.  No rule looks back, and none of these ends depends on
    what follows.
    """
    kind = _KINDS[data]
    word = kind == 1
    word[1:] |= (kind[:-1] == 4) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    line, ends = data == 10, word | (kind == 2)
    cut = np.zeros(len(data), bool)
    cut[1:] = (word[:-1] & (kind[1:] == 2)) | (ends[:-1] & line[1:])
    cut[2:] |= ends[:-2] & line[1:-1] & (kind[2:] > 0)
    return cut


class WordEncoder:
    """The tokenizer's own ids, with each distinct word or mark encoded once.

    The vocabulary's pre-tokenizer never joins characters across a single
    space, so a text without double spaces is the sequence of its space-led
    pieces; where it is the byte-level one, these are cut further (see
    ``inner_cuts``), so that a word is the same before a comma.  Other texts,
    and texts that spell a special token, go through the tokenizer whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        splits = plan.get("pre_tokenizer") or {}
        self.cuts = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not splits.get("add_prefix_space") and not plan.get("normalizer")
        self.cache_words = cache_words
        self.clear()

    def clear(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0
        self.raw_at, self.raw_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)
        self.flat = np.zeros(1 << 16, np.uint16)
        self.starts, self.lengths = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.used = self.count = 0

    def forget(self) -> None:
        """Drop the words that were met in one stretch alone; all, if that leaves over half of what may be kept."""
        stay = np.flatnonzero(self.again)
        if 2 * len(stay) > self.cache_words:
            return self.clear()
        known, at, size, number = self.known[stay], self.raw_at[stay], self.raw_size[stay], self.number[stay]
        raw, lengths = self.raw[ragged_take(at, size)], self.lengths[number]
        ids = self.flat[ragged_take(self.starts[number], lengths)]
        self.clear()
        self.known, self.number, self.again = known, np.arange(len(known)), np.zeros(len(known), bool)
        self._add(ids, lengths)
        self._hold(raw)
        self.raw_at, self.raw_size = np.cumsum(size) - size, size

    def _hold(self, raw: np.ndarray) -> None:
        while self.raw_used + len(raw) + 8 > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        self.raw_used += len(raw)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _add(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Store the runs of ids; returns the first one's number."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(lengths) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        at = self.count
        self.flat[self.used : self.used + len(ids)] = ids
        self.lengths[at : at + len(lengths)] = lengths
        self.starts[at : at + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.used, self.count = self.used + len(ids), at + len(lengths)
        return at

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Encode space-led pieces; their numbers."""
        out = np.empty(len(new), np.int64)
        blank = [i for i, w in enumerate(new) if not w]
        if blank:
            ids = self.whole(" ")
            out[blank] = self._add(ids, np.array([len(ids)]))
        rest = [i for i, w in enumerate(new) if w]
        for a in range(0, len(rest), 50_000):
            where = rest[a : a + 50_000]
            part = [new[i] for i in where]
            joined = [(b" " + b" ".join(part[i : i + 1000])).decode("utf-8", "surrogatepass") for i in range(0, len(part), 1000)]
            done = self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(x.ids for x in done), np.uint16)
            leads = np.flatnonzero(self.leads[ids])
            if len(leads) == len(part) and leads[0] == 0:
                at = self._add(ids, np.diff(np.r_[leads, len(ids)]))
            else:
                done = [self.whole(" " + w.decode("utf-8", "surrogatepass")) for w in part]
                at = self._add(np.concatenate(done), np.array([len(x) for x in done]))
            out[where] = np.arange(at, at + len(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has."""
        if len(self.known) > self.cache_words:
            self.forget()
        plain = [not ("  " in t or any(s in t for s in self.special)) for t in texts]
        # A space before each text ends the piece before it; a text's first piece is told by its place.  Pieces with no space are marked in their hash.
        raw = [t.encode("utf-8", "surrogatepass") for t, p in zip(texts, plain, strict=True) if p]
        buffer = b" ".join([b"", *raw, b""])
        padded = np.frombuffer(buffer + bytes(8), np.uint8)
        data, lane = padded[:-8], lanes(padded)
        space = data == 32
        cut = inner_cuts(data) if self.cuts else np.zeros(len(data), bool)
        begins = cut.copy()
        begins[1:] |= space[:-1]
        starts = np.flatnonzero(begins)
        is_first = cut[starts]
        ends = np.append(starts[1:] - ~is_first[1:], len(data) - 1)
        heads = np.cumsum([1, *(len(r) + 1 for r in raw)])[:-1]
        first = np.searchsorted(starts, heads)
        is_first[first] = True
        hashes = (run_hashes(data, starts, ends) & ~np.uint64(1)) | is_first.astype(np.uint64)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.r_[True, ranked[1:] != ranked[:-1]] if len(ranked) else np.zeros(0, bool)
        lead = order[new]
        index = np.empty(len(starts), np.int64)
        group = np.cumsum(new) - 1
        mine, its = starts[order], starts[lead][group]
        sizes, numbers = ends[order] - mine, None
        if np.array_equal(sizes, (ends[lead] - starts[lead])[group]) and same_lanes(lane, mine, lane, its, sizes):
            numbers = self._numbers(buffer, lane, hashes[lead], starts[lead], ends[lead], is_first[lead])
        if numbers is None:  # two pieces with one hash: the tokenizer takes the texts whole
            done = [self.whole(t) for t in texts]
            return np.concatenate([np.zeros(0, np.uint16), *done]), np.array([len(x) for x in done], np.int64)
        index[order] = numbers[group]
        lengths = self.lengths[index]
        ids = self.flat[ragged_take(self.starts[index], lengths)]
        upto = np.r_[0, np.cumsum(lengths)]
        own = np.diff(upto[np.r_[first, len(starts)]])
        if all(plain):
            return ids, own
        counts, parts, at, k = np.zeros(len(texts), np.int64), [], 0, 0
        for i, p in enumerate(plain):
            if p:
                parts.append(ids[at : at + own[k]])
                counts[i] = own[k]
                at, k = at + own[k], k + 1
            else:
                parts.append(self.whole(texts[i]))
                counts[i] = len(parts[-1])
        return np.concatenate(parts), counts

    def _numbers(self, buffer: bytes, lane: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray | None:
        """Numbers of the distinct pieces' runs of ids, whose hashes ascend; None if a hash stands for two pieces."""
        sizes = ends - starts
        at = np.searchsorted(self.known, hashes)
        hit = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        hit[inside] = self.known[at[inside]] == hashes[inside]
        old = at[hit]
        self.again[old] = True
        if not np.array_equal(self.raw_size[old], sizes[hit]) or not same_lanes(lane, starts[hit], lanes(self.raw), self.raw_at[old], sizes[hit]):
            return None
        if not hit.all():
            new = np.flatnonzero(~hit)
            pieces = [buffer[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            fresh = np.empty(len(new), np.int64)
            led = np.flatnonzero(~first[new])
            fresh[led] = self._learn([pieces[i] for i in led.tolist()])
            bare = np.flatnonzero(first[new])
            if len(bare):
                done = [x.ids for x in self.tokenizer.encode_batch_fast([pieces[i].decode("utf-8", "surrogatepass") for i in bare.tolist()], add_special_tokens=False)]
                begin = self._add(np.fromiter(chain.from_iterable(done), np.uint16), np.array([len(x) for x in done]))
                fresh[bare] = np.arange(begin, begin + len(bare))
            places = self.raw_used + np.cumsum(sizes[new]) - sizes[new]
            self._hold(np.frombuffer(b"".join(pieces), np.uint8))
            self.known, self.number = np.insert(self.known, at[new], hashes[new]), np.insert(self.number, at[new], fresh)
            self.again = np.insert(self.again, at[new], False)
            self.raw_at, self.raw_size = np.insert(self.raw_at, at[new], places), np.insert(self.raw_size, at[new], sizes[new])
            at = np.searchsorted(self.known, hashes)
        return self.number[at]


def same_lanes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether all runs of bytes, read from ``lanes``, are equal, eight bytes at a time."""
    done, go = 0, np.flatnonzero(sizes)
    while len(go):
        left = sizes[go] - done
        cut = (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)).astype(np.uint64)
        if (((a[a_at[go] + done] ^ b[b_at[go] + done]) << cut) != 0).any():
            return False
        go, done = go[left > 8], done + 8
    return True


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, sizes: np.ndarray) -> bool:
    """Whether all runs of bytes are equal."""
    spare = np.zeros(8, np.uint8)
    return same_lanes(lanes(np.r_[a, spare]), a_at, lanes(np.r_[b, spare]), b_at, sizes)


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, whose words stay known from task to task."""
    return kept(f"encoder:{path}", lambda: WordEncoder(path))


def compress(ids: np.ndarray, least: int = 24, per_round: int = 4096, gain: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: symbols, rules (left, right), expansion lengths of the rules.

    Rounds go on until no pair occurs ``least`` times, no symbol is free, or a
    round has shortened the sequence by less than a ``gain`` of its length.
    """
    seq = np.asarray(ids, np.uint16)
    rules: list[np.ndarray] = []
    lengths = np.zeros(LIMIT - BASE, np.uint32)
    free = BASE
    size = np.ones(LIMIT, np.uint32)
    while len(seq) > 1 and free < LIMIT:
        pair = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        slot = ((pair * np.uint32(2654435761)) >> np.uint32(14)).astype(np.intp)
        filled = np.bincount(slot, minlength=1 << 18)
        most = min(per_round, LIMIT - free)
        floor = max(least, int(np.partition(filled, -4 * most)[-4 * most]))
        kinds, counts = np.unique(pair[(filled >= floor).take(slot)], return_counts=True)
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] >= least][: 4 * most]
        role = np.zeros(LIMIT, np.int8)
        chosen = []
        for k in kinds[order].tolist():
            a, b = k >> 16, k & 0xFFFF
            if a == b:
                if role[a] == 0:
                    role[a] = 3
                    chosen.append(k)
            elif role[a] in (0, 1) and role[b] in (0, 2):
                role[a], role[b] = 1, 2
                chosen.append(k)
            if len(chosen) == most:
                break
        if not chosen:
            break
        keys = np.array(chosen, np.uint32)
        by = np.argsort(keys)
        played = role.take(seq)
        maybe = np.flatnonzero((played[:-1] & 1) & (played[1:] >> 1))
        wanted = np.zeros(1 << 18, bool)
        wanted[(keys * np.uint32(2654435761)) >> np.uint32(14)] = True
        maybe = maybe[wanted.take(slot[maybe])]
        here = pair[maybe]
        ranked, spot = keys[by], slot[maybe]
        home = (ranked * np.uint32(2654435761)) >> np.uint32(14)
        nearest = np.zeros(1 << 18, np.int32)
        nearest[home] = np.arange(len(ranked))
        found = nearest.take(spot)
        shared = np.bincount(home, minlength=1 << 18).take(spot) > 1  # several keys of one slot
        found[shared] = np.minimum(np.searchsorted(ranked, here[shared]), len(ranked) - 1)
        real = ranked[found] == here
        at, which = maybe[real], by[found[real]]
        same = (keys[which] >> 16) == (keys[which] & 0xFFFF)
        if same.any():  # in a run of one symbol, every other place
            spots = at[same]
            head = np.r_[True, spots[1:] != spots[:-1] + 1]
            first = np.maximum.accumulate(np.where(head, np.arange(len(spots)), 0))
            keep = np.ones(len(at), bool)
            keep[np.flatnonzero(same)] = (np.arange(len(spots)) - first) % 2 == 0
            at, which = at[keep], which[keep]
        new = np.stack([keys >> 16, keys & 0xFFFF], axis=1).astype(np.uint16)
        rules.append(new)
        size[free : free + len(keys)] = size[new[:, 0]] + size[new[:, 1]]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq.copy()
        seq[at] = (free + which).astype(np.uint16)
        before, seq = len(seq), seq[stay]
        free += len(keys)
        if before - len(seq) < gain * before:
            break
    lengths = size[BASE:free]
    return seq, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16), lengths


def expand(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """Ids of symbols; a rule only names symbols of earlier rounds, so a few passes do."""
    seq = np.asarray(seq, np.uint16)
    while (big := seq >= BASE).any():
        wide = 1 + big.astype(np.int64)
        at = np.cumsum(wide) - wide
        out = np.empty(int(wide.sum()), np.uint16)
        which = seq[big].astype(np.int64) - BASE
        out[at] = seq
        out[at[big]] = rules[which, 0]
        out[at[big] + 1] = rules[which, 1]
        seq = out
    return seq


def write_shard(folder: str, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> tuple[str, int, int]:
    seq, rules, lengths = compress(ids)
    width = np.where(seq >= BASE, np.r_[lengths, np.zeros(1, np.uint32)][np.where(seq >= BASE, seq.astype(np.int64) - BASE, -1)], 1)
    offsets = (np.cumsum(width, dtype=np.int64) - width)[::SAMPLE_EVERY]
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        np.array([0 if d is None else d for d in doc_ids], "<i8"), known, counts.astype("<u8"),
        rules.astype("<u2"), lengths.astype("<u4"), offsets.astype("<i8"), seq.astype("<u2"),
    ]
    store, path = open_fs(f"{folder}/shard-{uuid.uuid4().hex}.rptok")
    with store.open_output_stream(path, compression=None) as out:
        out.write(MAGIC + struct.pack("<5Q", len(doc_ids), len(ids), len(rules), len(seq), len(offsets)))
        for x in parts:
            out.write(x.tobytes())
    return path.rsplit("/", 1)[1], len(seq), len(rules)


class Shard:
    """A shard's parts; reads its file in one go or, for a range of ids, only the symbols it needs."""

    def __init__(self, folder: str, name: str):
        self.store, self.path = open_fs(f"{folder}/{name}")
        with self.store.open_input_file(self.path) as f:
            if f.read(8) != MAGIC:
                raise ValueError(f"{name} is no token shard")
            docs, self.n_ids, n_rules, self.n_symbols, n_offsets = struct.unpack("<5Q", f.read(40))
            take = lambda kind, n: np.frombuffer(f.read(np.dtype(kind).itemsize * n), kind)
            self.doc_ids, self.known, self.counts = take("<i8", docs), take("u1", docs), take("<u8", docs).astype(np.int64)
            self.rules = take("<u2", 2 * n_rules).reshape(-1, 2)
            self.lengths, self.offsets = take("<u4", n_rules), take("<i8", n_offsets)
            self.symbols_at = f.tell()
        self.starts = np.cumsum(self.counts) - self.counts

    def _symbols(self, first: int, last: int) -> np.ndarray:
        with self.store.open_input_file(self.path) as f:
            f.seek(self.symbols_at + 2 * first)
            return np.frombuffer(f.read(2 * (last - first)), "<u2")

    def all_ids(self) -> np.ndarray:
        return expand(self._symbols(0, self.n_symbols), self.rules)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``[start, stop)`` of the shard."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint16)
        block = int(np.searchsorted(self.offsets, start, side="right")) - 1
        after = int(np.searchsorted(self.offsets, stop, side="left"))
        symbols = self._symbols(block * SAMPLE_EVERY, min(after * SAMPLE_EVERY, self.n_symbols))
        big = symbols >= BASE
        width = np.ones(len(symbols), np.int64)
        width[big] = self.lengths[symbols[big].astype(np.int64) - BASE]
        ends = int(self.offsets[block]) + np.cumsum(width)
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))
        skip = start - (int(ends[a]) - int(width[a]))
        return expand(symbols[a : b + 1], self.rules)[skip : skip + stop - start]


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all documents in ascending order of id; returns the committed manifest of shards."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers

        own = encoder(vocabulary or public_tokenizers.path(VOCABULARY))
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            nonlocal seq
            ids = np.concatenate([h[2] for h in held])
            counts = np.concatenate([h[1] for h in held])
            who = list(chain.from_iterable(h[0] for h in held))
            name, symbols, rules = write_shard(folder, who, counts, ids)
            seq += 1
            return pd.DataFrame({"part": [part], "seq": [seq], "path": [name], "docs": [len(who)], "ids": [len(ids)], "symbols": [symbols], "rules": [rules]})

        total = 0
        for pdf in batches:
            who = [None if d is pd.NA else int(d) for d in pdf["doc_id"].astype("Int64")]
            texts = pdf["text"].tolist()
            a = 0
            while a < len(texts):
                b, size = a, 0
                while b < len(texts) and (b == a or size + len(texts[b]) < PART_CHARS):
                    size += len(texts[b])
                    b += 1
                ids, counts = own.encode(texts[a:b])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, np.uint16(end_id))
                held.append((who[a:b], counts + 1, ids))
                total += len(ids)
                a = b
                if total >= shard_ids:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Rows of one id, or without any, are dealt by their texts' beginnings, which keeps their order.
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInPandas(tidy(write, True), MANIFEST), "token-manifest")


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds ``base``, the ids before each shard: totals of tasks first, then of the shards of a task."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inner = manifest.withColumn("own", F.coalesce(F.sum("ids").over(own), F.lit(0)))
    return inner.join(parts, "part").withColumn("base", F.col("part_base") + F.col("own")).drop("part_base", "own")


def read_tokens(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` (and the ids) of every document, from the shards."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, base in zip(pdf["path"], pdf["base"], strict=True):
                shard = Shard(folder, name)
                ids = shard.all_ids().astype("<u4")
                ends = shard.starts + shard.counts
                raw, known = ids.tobytes(), shard.known.astype(bool)
                out = pd.DataFrame({
                    "doc_id": pd.array(np.where(known, shard.doc_ids, 0), "Int64"),
                    "start": shard.starts + base,
                    "n_tokens": shard.counts,
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(shard.starts.tolist(), ends.tolist(), strict=True)],
                })
                out.loc[~known, "doc_id"] = pd.NA
                if with_ids:
                    out["ids"] = [ids[a:b].astype(np.int32) for a, b in zip(shard.starts, ends, strict=True)]
                yield out

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spread(with_base(manifest).select("path", "base", "ids"), "path", "ids", 32 << 20).mapInPandas(tidy(read), schema)


def token_round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write all documents to shared shards and read them back."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, **options), folder)
