"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 2-bit segments are mapped to their bit counts, a point of a
32-dimensional grid.  The Manhattan distance of two points is never above the
Hamming distance of their fingerprints, so points within ``distance`` hold
every link.  The grid is cut into ``distance + 2`` blocks of dimensions; a
change of one count touches one block, so two linked points share the cells
of at least two blocks.  Distinct fingerprints meet in those cells, where the
Manhattan bound is tested first and the exact distance then.

Only distinct fingerprints are compared; copies follow by a join.  A cell
gives a spanning forest of its links, not all pairs, which keeps every
connection.  A cell beyond ``cell_rows`` fingerprints is refined: the other
dimensions are cut into ``distance + 2`` blocks again, two of which linked
points share too.  What is still crowded then is cut into chunks whose pairs
become tasks of their own; nothing is dropped.

Defined cases: null and blank texts have no words and fingerprint zero, which
links like any other; fewer words than a shingle make one shingle; rows that
repeat an id are handled as rows of one class; a component without any id has
a null ``component_id``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import tidy
from chronoloom.operators.components import connected_components
from chronoloom.plans.materialize import materialize

LOW_BITS = 0x5555555555555555
SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash: a bit is set if over half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    k = min(shingle, len(words))
    starts = [0, *ends[: len(ends) - k]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": np.array([fingerprint(t, shingle) for t in pdf["text"]], np.int64)})

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(tidy(run), "doc_id long, fp long")


def block_masks(distance: int, dims: range | list[int] = range(32)) -> list[int]:
    """Signed masks, one for each pair of ``distance + 2`` blocks of the dimensions (two bits a dimension)."""
    edges = [round(i * len(dims) / (distance + 2)) for i in range(distance + 3)]
    blocks = [sum(3 << (2 * d) for d in dims[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(x | y) for x, y in combinations(blocks, 2)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks that hold ``mask`` and two blocks of the dimensions outside it."""
    bits = mask & (1 << 64) - 1
    return [_signed(bits | (m & (1 << 64) - 1)) for m in block_masks(distance, [d for d in range(32) if not bits >> (2 * d) & 1])]


def _signed(x: int) -> int:
    return int(np.uint64(x).astype(np.int64))


def embed(fp) -> np.ndarray:
    """Bit counts of the 2-bit segments, each in unary, so that XOR and a bit count give the Manhattan distance."""
    fp = np.asarray(fp).astype(np.int64).view(np.uint64)
    low, high = fp & np.uint64(LOW_BITS), (fp >> np.uint64(1)) & np.uint64(LOW_BITS)
    return (low | high) | ((low & high) << np.uint64(1))


def _embed_column():
    low, high = F.col("fp").bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def link_sorted(cells: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each run of equal ``cells``."""
    n = len(fps)
    change = np.flatnonzero(cells[1:] != cells[:-1]) + 1 if n else np.zeros(0, np.int64)
    bounds = np.concatenate([change, [n]])
    end = bounds[np.searchsorted(change, np.arange(n), side="right")]
    raw, point = fps.view(np.uint64), embed(fps)
    root = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    live, d = np.arange(n), 1
    while len(live := live[live + d < end[live]]):
        near = live[np.bitwise_count(point[live] ^ point[live + d]) <= distance]
        near = near[np.bitwise_count(raw[near] ^ raw[near + d]) <= distance]
        near = near[root[near] != root[near + d]]
        for i in near.tolist():
            a, b = find(i), find(i + d)
            if a != b:
                root[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + d)
        if len(near):
            while not np.array_equal(up := root[root], root):
                root = up
        d += 1
    return fps[left], fps[right]


def links(distinct: DataFrame, distance: int = 4, cell_rows: int = 4096) -> DataFrame:
    """Forest links ``a``, ``b`` between distinct fingerprints at ``distance`` or fewer differing bits."""
    masks = block_masks(distance)
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("block", "mask")).select(
        "fp", "block", _embed_column().bitwiseAND(F.col("mask")).alias("cell")
    )

    def per_group(batches: Iterator[pd.DataFrame], keys: list[str], limit: int | None) -> Iterator[pd.DataFrame]:
        """Streams rows sorted by ``keys``; a run over ``limit`` leaves as numbered chunks."""
        carry, over = None, 0
        for pdf in batches:
            if carry is not None and len(carry):
                pdf = pd.concat([carry, pdf], ignore_index=True)
            if not len(pdf):
                continue
            names = pdf[keys].to_numpy(np.int64)
            new = np.r_[True, (names[1:] != names[:-1]).any(axis=1)]
            group = np.cumsum(new) - 1
            starts = np.flatnonzero(new)
            if over and tuple(names[0]) != over[0]:
                over = 0
            sizes = np.diff(np.r_[starts, len(pdf)])
            last = starts[-1]
            hot = np.zeros(len(pdf), bool)
            if limit is not None:
                base = np.zeros(len(starts), np.int64)
                if over:
                    base[0] = over[1]
                hot_groups = (sizes + base > limit) | (base > 0)
                hot = hot_groups[group]
                if hot.any():
                    chunk = (np.arange(len(pdf)) - starts[group] + base[group]) // limit
                    at = np.flatnonzero(hot)
                    yield pd.DataFrame({"kind": 1, "block": names[at, 0], "cell": names[at, 1], "a": pdf["fp"].to_numpy()[at], "b": chunk[at]})
                over = (tuple(names[-1]), int(base[-1] + sizes[-1])) if hot[-1] else 0
            keep_last = limit is not None and not hot[-1]
            stop = last if keep_last or limit is None else len(pdf)
            take = np.flatnonzero(~hot[:stop])
            carry = pdf.iloc[last:].reset_index(drop=True) if stop == last else None
            if len(take):
                a, b = link_sorted(group[take], pdf["fp"].to_numpy(np.int64)[take], distance)
                if len(a):
                    yield pd.DataFrame({"kind": 0, "block": 0, "cell": 0, "a": a, "b": b})
        if carry is not None and len(carry):
            a, b = link_sorted(np.zeros(len(carry), np.int64), carry["fp"].to_numpy(np.int64), distance)
            if len(a):
                yield pd.DataFrame({"kind": 0, "block": 0, "cell": 0, "a": a, "b": b})

    schema = "kind int, block int, cell long, a long, b long"

    def met(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Links of the cells, and the rows of crowded ones."""
        found = rows.repartition("block", "cell").sortWithinPartitions("block", "cell").mapInPandas(lambda it: per_group(it, ["block", "cell"], cell_rows), schema)
        found = materialize(found, "simhash-cells")
        hot = found.where("kind = 1").select("block", "cell", F.col("a").alias("fp"), F.col("b").alias("chunk"))
        return found.where("kind = 0").select("a", "b"), None if hot.isEmpty() else hot

    plain, hot = met(keyed)
    if hot is None:
        return plain
    finer = F.array(*[F.array(*[F.lit(m) for m in finer_masks(mask, distance)]) for mask in masks])
    deeper = hot.select("fp", "block", F.posexplode(F.get(finer, F.col("block"))).alias("sub", "mask"))
    again, hot = met(deeper.select("fp", (F.col("block") * len(masks) + F.col("sub")).alias("block"), _embed_column().bitwiseAND(F.col("mask")).alias("cell")))
    plain = plain.unionAll(again)
    if hot is None:
        return plain
    last = hot.groupBy("block", "cell").agg(F.max("chunk").alias("last"))
    paired = hot.join(last, ["block", "cell"]).select(
        "block", "cell", "fp", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other")
    )
    paired = paired.select("block", "cell", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "fp")
    keys = ["block", "cell", "lo", "hi"]
    more = paired.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda it: per_group(it, keys, None), schema)
    return plain.unionAll(materialize(more, "simhash-chunks").select("a", "b"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, **columns) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id`` of every row."""
    marked = materialize(fingerprints(docs, shingle=shingle, **columns), "simhash")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    groups = materialize(connected_components(links(distinct, distance), "a", "b"), "simhash-groups")
    named = groups.withColumnRenamed("id", "fp").join(distinct, "fp")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = named.join(smallest, "component").select("fp", "component_id")
    final = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return marked.join(final, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
