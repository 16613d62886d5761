"""Benchmark decontamination over a positional inverted index.

Training documents are cut into blocks of a bounded number of words.  A block's
index holds, for each term, the ascending word positions at which it stands in
the block, delta-coded; the blocks form one table in the shared folder, dealt
over the cluster by document, so building and searching need no shuffle and a
lost task repeats its own blocks only.

The test phrases (windows) are written to files of a bounded size in the shared
folder, whatever their number; a search reads the index once and, for every
batch of blocks, one file of phrases after another, so neither the driver nor a
task ever holds the test set whole.  In a block, a phrase starts with the
postings of its rarest term, shifted by that term's offset, and intersects them
with the other terms' shifted lists, the next rarest first.  All phrases of a
file take these steps together, as arrays: their candidates are bounded in
number, and one search in the block's postings tells which of them a step keeps.
With ``slop`` above zero a phrase starts at its first word and every other word
may stand that many words off its place, inside the document (proximity); the
answer doesn't depend on how documents fall into blocks.

Defined cases: null texts have no words; an item with fewer words than a window
is one window, an item without words none; items without an id mark words but
are not named; equal ids are one item; rows that repeat a document id are
judged each; empty tables give no rows, or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import mix, open_fs, ragged_take, tidy
from chronoloom.plans.materialize import materialize, new_folder

WINDOW = 10
#: Words after which a block ends; bytes of test text in one file of phrases.
BLOCK_WORDS, CHUNK_BYTES = 400_000, 4 << 20
#: Blocks that are unpacked at a time; candidate places in one round of a search.
HELD_BLOCKS, CANDIDATES = 8, 1 << 20
#: Default slop of the proximity query.
SLOP = 2
_WORD = bytes(ord(chr(c).lower()) if chr(c).isalnum() and c < 128 else c if c >= 128 else 32 for c in range(256))
INDEX = "block long, doc_ids binary, known binary, ends binary, terms binary, term_ends binary, postings binary"


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def _pack(x: np.ndarray) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstd.ZstdDecompressor().decompress(bytes(raw)), kind)


def _index_block(block: int, ids: list, words: list[bytes], ends: list[int]) -> dict:
    numbers: dict[bytes, int] = {}
    put = numbers.setdefault
    term = np.fromiter((put(w, len(numbers)) for w in words), np.int64, len(words))
    order = np.sort((term << 32) | np.arange(len(words)))
    spots, term = (order & 0xFFFFFFFF).astype(np.uint32), order >> 32
    counts = np.bincount(term, minlength=len(numbers))
    upto = np.cumsum(counts)
    delta = spots.copy()
    delta[1:] -= spots[:-1]
    first = upto - counts
    delta[first] = spots[first]
    return {
        "block": block,
        "doc_ids": _pack(np.array([0 if d is None else d for d in ids], np.int64)),
        "known": _pack(np.array([d is not None for d in ids], np.uint8)),
        "ends": _pack(np.array(ends, np.uint32)),
        "terms": zstd.ZstdCompressor(level=1).compress(b" ".join(numbers)),
        "term_ends": _pack(upto.astype(np.uint32)),
        "postings": _pack(delta),
    }


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One numbered row for each block of documents; kept in the shared folder for any number of searches."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, ends, block = [], [], [], TaskContext.get().partitionId() << 32
        for pdf in batches:
            for d, t in zip(pdf["doc_id"].astype("Int64"), pdf["text"], strict=True):
                ids.append(None if d is pd.NA else int(d))
                words.extend(words_of(t))
                ends.append(len(words))
                if len(words) >= block_words:
                    yield pd.DataFrame([_index_block(block, ids, words, ends)])
                    ids, words, ends, block = [], [], [], block + 1
        if ids:
            yield pd.DataFrame([_index_block(block, ids, words, ends)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialize(rows.mapInPandas(tidy(build), INDEX), "postings")


class Phrases:
    """Test phrases of one file: a matrix of term numbers and, in a ragged list, the items of each phrase."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        number = {name: n for n, name in enumerate(self.names)}
        put = self.vocabulary.setdefault
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item, text in items:
            words = words_of(text)
            if words:
                terms = np.fromiter((put(w, len(self.vocabulary)) for w in words), np.int32, len(words))
                if len(terms) < window:
                    terms = np.r_[terms, np.full(window - len(terms), -1, np.int32)]
                rows.append(np.lib.stride_tricks.sliding_window_view(terms, window))
                owners.append(np.full(len(rows[-1]), number.get(item, -1)))
        terms, owner = np.concatenate(rows), np.concatenate(owners)
        # Equal windows are neighbours in the order of their hashes; a clash of hashes at most leaves a window twice.
        hashes = np.zeros(len(terms), np.uint64)
        for column in terms.T:
            hashes = mix(hashes + column.astype(np.uint64))
        order = np.argsort(hashes, kind="stable")
        terms, owner = terms[order], owner[order]
        new = np.r_[True, (terms[1:] != terms[:-1]).any(axis=1)][: len(terms)]
        self.terms = terms[new]
        self.lengths = (self.terms >= 0).sum(axis=1)
        pairs = np.unique((np.cumsum(new) - 1 << 32 | owner)[owner >= 0])
        self.items = pairs & 0xFFFFFFFF
        self.item_ends = np.searchsorted(pairs >> 32, np.arange(len(self.terms)), side="right")


class Block:
    """A block's postings: ascending keys of a term's number and a word's place."""

    def __init__(self, row):
        known, ids = _unpack(row.known, np.uint8), _unpack(row.doc_ids, np.int64)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.ends = _unpack(row.ends, np.uint32).astype(np.int64)
        self.first = np.r_[0, self.ends[:-1]]
        self.upto = _unpack(row.term_ends, np.uint32).astype(np.int64)
        self.names = zstd.ZstdDecompressor().decompress(bytes(row.terms)).split(b" ") if len(self.upto) else []
        self.sizes = np.diff(self.upto, prepend=0)
        sums = np.cumsum(_unpack(row.postings, np.uint32), dtype=np.int64)
        self.spots = sums - np.repeat(np.r_[0, sums][self.upto - self.sizes], self.sizes)
        self.keys = (np.repeat(np.arange(len(self.upto)), self.sizes) << 32) + self.spots
        self.docs = np.searchsorted(self.ends, self.spots, side="right").astype(np.int32)

    def place(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """The block's number of each term of a vocabulary, -1 for one that doesn't stand here."""
        place = np.full(len(vocabulary) + 1, -1, np.int64)
        mine = np.fromiter((vocabulary.get(n, -1) for n in self.names[: len(self.upto)]), np.int64, len(self.upto))
        here = np.flatnonzero(mine >= 0)
        place[mine[here]] = here
        return place

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term stands at one of the places from ``low`` to ``high``."""
        if not len(self.keys):
            return np.zeros(len(term), bool)
        at = np.searchsorted(self.keys, (term << 32) + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 32) + high)


def search_block(block: Block, phrases: Phrases, slop: int = 0, most: int = CANDIDATES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases with the places and documents where they start, about ``most`` candidates at a time.

    Candidates are the places of each phrase's rarest term here; every further
    term, the next rarest first, keeps those at whose shifted place it stands.
    """
    terms = block.place(phrases.vocabulary)[phrases.terms]
    padding = phrases.terms < 0
    live = np.flatnonzero(((terms >= 0) | padding).all(axis=1))
    if not len(live):
        return
    terms, padding, lengths = terms[live], padding[live], phrases.lengths[live]
    often = np.where(padding, np.iinfo(np.int64).max, block.sizes[terms])
    order = np.argsort(often, axis=1, kind="stable")
    rarest = order[:, 0]
    rows = np.arange(len(live))
    seed, size = terms[rows, rarest], often[rows, rarest]
    shifts = np.arange(-slop, slop + 1)
    upto = np.cumsum(size * len(shifts))
    begin = 0
    while begin < len(live):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, side="right")))
        number = size[begin:end]
        at = ragged_take((block.upto - block.sizes)[seed[begin:end]], number)
        p = np.repeat(rows[begin:end], number)
        starts, doc = block.spots[at] - rarest[p], block.docs[at]
        if slop:
            starts = (starts[:, None] + shifts).ravel()
            p, doc = np.repeat(p, len(shifts)), np.repeat(doc, len(shifts))
        # Exact phrases end in their document; in proximity only the first word's place is fixed.
        inside = (starts >= block.first[doc]) & (starts + (1 if slop else lengths[p]) <= block.ends[doc])
        p, starts, doc = p[inside], starts[inside], doc[inside]
        if slop:
            near = block.holds(terms[p, 0], starts, starts)
            p, starts, doc = p[near], starts[near], doc[near]
        for step in range(1 - (slop > 0), order.shape[1]):
            if not len(p):
                break
            offset = order[p, step]
            low, high = starts + offset, starts + offset
            if slop:
                free = np.where(offset > 0, slop, 0)
                low, high = np.maximum(low - free, block.first[doc]), np.minimum(high + free, block.ends[doc] - 1)
            near = block.holds(terms[p, offset], low, high) | padding[p, offset]
            p, starts, doc = p[near], starts[near], doc[near]
        if len(p):
            yield live[p], starts, doc
        begin = end


SEARCHED = "block long, doc_no int, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"
DIGEST = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def write_phrases(items: DataFrame, item_id: str, text: str, chunk_bytes: int) -> list[str]:
    """Write the items to files of about ``chunk_bytes`` of text; the committed files' URIs."""
    folder = new_folder(items.sparkSession, "phrases")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            store, path = open_fs(uri := f"{folder}/items-{uuid.uuid4().hex}")
            with store.open_output_stream(path, compression=None) as out:
                out.write(pickle.dumps(held))
            return pd.DataFrame({"path": [uri]})

        for pdf in batches:
            for item, body in zip(pdf["item"], pdf["text"], strict=True):
                held.append((item, body))
                size += len(body or "")
                if size >= chunk_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return sorted(r.path for r in materialize(rows.coalesce(1 << 10).mapInPandas(tidy(write), "path string"), "phrase-files").collect())


def _phrases(path: str, window: int) -> Phrases:
    store, at = open_fs(path)
    with store.open_input_stream(at, compression=None) as f:
        return Phrases(pickle.loads(f.read()), window)


def _searched(index: DataFrame, items: DataFrame, window: int, slop: int, item_id: str, text: str, chunk_bytes: int, schema: str, shape) -> DataFrame:
    """``shape`` of every block's result, in one pass over the index."""
    files = write_phrases(items, item_id, text, chunk_bytes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only = _phrases(files[0], window) if len(files) == 1 else None
        for pdf in batches:
            for at in range(0, len(pdf), HELD_BLOCKS):
                blocks = [Found(row) for row in pdf.iloc[at : at + HELD_BLOCKS].itertuples(index=False)]
                for path in files:
                    phrases = only or _phrases(path, window)
                    for found in blocks:
                        found.add(phrases, slop)
                while blocks:
                    yield shape(blocks.pop(0))

    return index.mapInPandas(tidy(run), schema)


class Found:
    """Hit words and named items of a block's documents, over any number of phrase files."""

    def __init__(self, row):
        self.number, self.block = int(row.block), Block(row)
        self.hit = np.zeros(int(self.block.ends[-1]) if len(self.block.ends) else 0, bool)
        self.named: dict[int, set[str]] = defaultdict(set)

    def add(self, phrases: Phrases, slop: int) -> None:
        block, n = self.block, len(self.hit)
        for k, starts, doc in search_block(block, phrases, slop):
            stops = np.minimum(starts + phrases.lengths[k], block.ends[doc])
            self.hit |= np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(stops, minlength=n + 1))[:n] > 0
            pairs = np.unique(doc.astype(np.int64) << 32 | k)
            k = pairs & 0xFFFFFFFF
            first = np.r_[0, phrases.item_ends][k]
            number = phrases.item_ends[k] - first
            pairs = np.unique(np.repeat(pairs >> 32, number) << 32 | phrases.items[ragged_take(first, number)])
            for d, i in zip((pairs >> 32).tolist(), (pairs & 0xFFFFFFFF).tolist(), strict=True):
                self.named[d].add(phrases.names[i])

    def items(self) -> list[list[str]]:
        return [sorted(self.named[d]) if d in self.named else [] for d in range(len(self.block.ends))]

    def listed(self) -> pd.DataFrame:
        block = self.block
        runs = []
        for a, b in zip(block.first.tolist(), block.ends.tolist(), strict=True):
            turns = np.flatnonzero(np.diff(self.hit[a:b].astype(np.int8), prepend=0, append=0))
            runs.append((turns[::2].tolist(), turns[1::2].tolist()))
        return pd.DataFrame({
            "block": self.number,
            "doc_no": np.arange(len(runs), dtype=np.int32),
            "doc_id": pd.array(block.doc_ids, "Int64"),
            "n_words": block.ends - block.first,
            "starts": [a for a, _ in runs],
            "ends": [b for _, b in runs],
            "items": self.items(),
        })

    def digest(self) -> pd.DataFrame:
        block = self.block
        upto = np.r_[0, np.cumsum(self.hit)]
        hit = upto[block.ends] - upto[block.first]
        items = self.items()
        return pd.DataFrame({
            "doc_id": pd.array(block.doc_ids, "Int64"),
            "n_words": block.ends - block.first,
            "n_hit": hit,
            "n_items": np.array([len(x) for x in items], np.int64),
            "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
            "contaminated": hit > 0,
        })


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, item_id: str = "item_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Every document with its hit runs (in words) and the items whose phrases it holds."""
    return _searched(index, items, window, slop, item_id, text, chunk_bytes, SEARCHED, Found.listed)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, chunk_bytes: int = CHUNK_BYTES, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slop: int = 0) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` of every document."""
    index = build_index(docs, doc_id, text, block_words)
    return _searched(index, items, window, slop, item_id, item_text, chunk_bytes, DIGEST, Found.digest)


#: The same answer in SQL, over tables ``documents`` and ``benchmark``.
ORACLE = f"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), {WINDOW}) AS size FROM items WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT size FROM wins),
grams AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM lowered, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, i, size, item_id FROM grams JOIN wins USING (size, g)),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, range(0, {WINDOW}) t(k) WHERE k < size GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

#: Proximity in SQL: places of a phrase's first word, with every other word within ``SLOP`` words of its place.
NEAR_ORACLE = f"""
WITH lowered AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT size, w[i:i + size - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), {WINDOW}) AS size FROM items WHERE len(w) > 0))),
owners AS (SELECT DISTINCT item_id, w[i:i + size - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT *, least(len(w), {WINDOW}) AS size FROM items WHERE len(w) > 0))),
words AS (SELECT row_no, w, unnest(range(1, len(w) + 1)) AS i FROM lowered),
ahead AS (SELECT row_no, i, w[i] AS a, unnest(list_append(list_distinct(w[greatest(1, i + 1 - {SLOP}):i + 1 + {SLOP}]), NULL)) AS b FROM words),
met AS (SELECT row_no, i, size, g FROM ahead JOIN wins ON a = g[1] AND b IS NOT DISTINCT FROM g[2]),
hits AS (SELECT row_no, i, size, g, len(w) AS n FROM met JOIN lowered USING (row_no)
    WHERE list_bool_and([list_contains(w[greatest(1, i + o - {SLOP}):i + o + {SLOP}], g[o + 1]) FOR o IN range(1, size)]) OR size = 1),
hit AS (SELECT row_no, count(DISTINCT i + k) AS n_hit FROM hits, range(0, {WINDOW}) t(k) WHERE k < size AND i + k <= n GROUP BY 1),
named AS (SELECT row_no, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT row_no, item_id::VARCHAR AS x FROM hits JOIN owners USING (g) WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hit USING (row_no) LEFT JOIN named USING (row_no)"""
