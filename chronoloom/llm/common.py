"""What several training-data operators share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; ``bytes.split()`` cuts at exactly these.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared URI (file, hdfs, s3, gs ...), for use on executors."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


_kept: dict[str, object] = {}


def trim() -> None:
    """Gives freed memory back to the system; worker processes live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept(name: str, make: Callable[[], object]) -> object:
    """One object for each worker process that stays from task to task; another name takes its place."""
    if name not in _kept:
        _kept.clear()
        trim()
        _kept[name] = make()
    return _kept[name]


def tidy(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A partition function after which freed memory goes back; one that keeps nothing drops what others kept."""

    def tidied(batches: Iterator) -> Iterator:
        if not keeps and _kept:
            _kept.clear()
            trim()
        yield from run(batches)
        trim()

    return tidied


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """For a query or pipeline to call: rows of long texts go to Python a thousand at a time, which bounds both sides' buffers.

    A setting of the session, so operators leave it to their caller.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(most))


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """For a query whose steps write tables: within, shuffle files go when the step that made them has ended.

    A setting of the session, which has its former value again afterwards.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread(manifest: DataFrame, by: str, size: str, per_task: int = 128 << 20) -> DataFrame:
    """The manifest's rows over several tasks, by their number and summed sizes.

    The number of partitions is explicit, so re-planning doesn't fold a short
    list of large files into one task.
    """
    files, total = manifest.agg(F.count("*"), F.sum(size)).first()
    most = max(4 * manifest.sparkSession.sparkContext.defaultParallelism, 2 * -(-(total or 0) // per_task))
    return manifest.repartition(max(1, min(2 * files, most)), by)


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that gather the runs ``[start, start + length)`` one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = np.asarray(starts, np.int64)[full], lengths[full]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of an array that ends in eight spare bytes, the first in the lowest byte."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def merge_runs(starts, ends) -> list[tuple[int, int]]:
    """Union of half-open runs, as sorted maximal runs (touching ones are joined)."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1] = b
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, up to ``n``."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_B, _B_INVERSE)):
            table = np.full(n + (n >> 2) + 64, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs ``values[start:end]``, from one prefix sum over all values."""
    up, down = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
