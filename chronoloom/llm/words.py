"""Words of many texts at once, as dictionary codes in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a byte becomes: a byte of a word, a gap between words, or a break that no phrase crosses.
GAP, BREAK = 0x20, 0x0A


def byte_table(gaps: bytes, breaks: bytes = b"") -> bytes:
    """For ``bytes.translate``: A-Z become lower-case, ``gaps`` and ``breaks`` their marks."""
    out = bytearray(range(256))
    out[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for b in gaps:
        out[b] = GAP
    for b in breaks:
        out[b] = BREAK
    return bytes(out)


@dataclass
class Words:
    """``codes`` into ``names`` (distinct words), the text each word is from, and whether the next word follows it in its piece."""

    names: pa.Array
    codes: np.ndarray
    text: np.ndarray
    runs_on: np.ndarray


def utf8(texts: pa.Array, table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts' translated bytes and the offsets between them; null texts are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = data[int(cuts[0]) : int(cuts[-1])].to_pybytes() if data is not None and cuts[-1] > cuts[0] else b""
    return np.frombuffer(raw.translate(table), np.uint8), cuts - cuts[0]


def split(texts: pa.Array, table: bytes) -> Words:
    """The words of all texts; equal words, compared byte by byte, share a code."""
    b, cuts = utf8(texts, table)
    inside = (b != GAP) & (b != BREAK)
    fresh = np.zeros(len(b) + 1, bool)  # where a text begins
    fresh[cuts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | fresh[1:-1]
    last[:-1] &= ~inside[1:] | fresh[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(b[inside])]).dictionary_encode()
    text = np.searchsorted(cuts, starts, "right") - 1
    piece = np.cumsum(b == BREAK, dtype=np.int64)[starts]
    runs_on = np.zeros(len(starts), bool)
    runs_on[:-1] = (text[1:] == text[:-1]) & (piece[1:] == piece[:-1])
    return Words(words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, runs_on)


def grouped(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, np.ndarray]]:
    """The batch's row numbers by the values of its (not null) key columns."""
    codes = np.zeros(batch.num_rows, np.int64)
    for key in keys:
        encoded = batch.column(key).dictionary_encode()
        codes = codes * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy(zero_copy_only=False)
        codes = np.unique(codes, return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    edges = np.flatnonzero(np.diff(codes[order], prepend=-1))
    for rows in np.split(order, edges[1:]) if len(order) else ():
        yield tuple(batch.column(key)[int(rows[0])].as_py() for key in keys), rows


def groups(batch: pa.RecordBatch, *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batch's rows by the values of its (not null) key columns."""
    for key, rows in grouped(batch, *keys):
        yield key, batch.take(pa.array(rows))


def strings(array: pa.Array) -> pa.Array:
    return array.cast(pa.string())


def constant(value: str, n: int) -> pa.Array:
    return pa.array([value] * n, pa.string()) if n < 2 else pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([value], pa.string())).cast(pa.string())
