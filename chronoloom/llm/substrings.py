"""Repeated word passages by difference-cover anchors.

Anchors are windows of ``anchor`` words that are hashed only where the word's
number modulo ``period`` lies in a difference cover.  For any two places some
shift below the period is covered at both, so two equal passages of
``period - 1 + anchor`` words share an aligned anchor.  Around anchors that
occur again, matches are extended: a context that occurs twice as a whole is
repeated throughout; of the others, the windows that hold the anchor are
compared with each other.

Defined cases: null texts have no words; texts shorter than a window lose
nothing; passages inside one text count, overlapping ones too; rows that repeat
an id are separate documents, which repeat each other; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import merge_runs, ragged_take, run_hashes
from chronoloom.llm.spans import collapse, keyed, marked, with_runs
from chronoloom.plans.materialize import materialize

WINDOW, PERIOD = 35, 21
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


@lru_cache
def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set whose differences give every residue, found by trying sizes upwards."""
    for size in range(1, period + 1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover
    return tuple(range(period))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of UTF-8 bytes."""
    gap = np.r_[True, _SPACES[data], True]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def _batch_words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, and where each text's words end."""
    data = np.frombuffer(b" ".join([*bodies, b""]), np.uint8)
    starts, ends = word_bounds(data)
    text_ends = np.cumsum([len(b) + 1 for b in bodies])
    return run_hashes(data, starts, ends), np.searchsorted(starts, text_ends)


def _parts(pdf: pd.DataFrame, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of rows of about ``size`` bytes."""
    a, total = 0, 0
    for b, body in enumerate(pdf["body"]):
        total += len(body)
        if total >= size:
            yield a, b + 1
            a, total = b + 1, 0
    if a < len(pdf):
        yield a, len(pdf)


def anchor_rows(docs: DataFrame, window: int, period: int) -> DataFrame:
    """``kind`` 1: a covered run already known; ``kind`` 0: an anchor at word ``a`` to compare."""
    size = window - period + 1
    cover = np.zeros(period, bool)
    cover[list(difference_cover(period))] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo, hi in _parts(pdf):
                words, ends = _batch_words(pdf["body"].iloc[lo:hi].tolist())
                first = np.r_[0, ends[:-1]]
                keys = pdf["key"].to_numpy(np.int64)[lo:hi]
                doc = np.repeat(np.arange(hi - lo), ends - first)
                own = np.arange(len(words)) - first[doc]
                n = (ends - first)[doc]
                at = np.flatnonzero(cover[own % period] & (own + size <= n) & (n >= window))
                if not len(at):
                    continue
                doc, own, n = doc[at], own[at], n[at]
                left, right = np.maximum(own - period + 1, 0), np.minimum(own + window, n)
                ah = run_hashes(words, at, at + size)
                ch = run_hashes(words, first[doc] + left, first[doc] + right) ^ (own - left).astype(np.uint64)
                lead, again = collapse(ah, ch)
                yield pd.DataFrame({"kind": 1, "ah": keys[doc[again]], "ch": 0, "key": keys[doc[again]], "a": left[again], "b": right[again]})
                yield pd.DataFrame({"kind": 0, "ah": ah[lead].view(np.int64), "ch": ch[lead].view(np.int64), "key": keys[doc[lead]], "a": own[lead], "b": right[lead]})

    return docs.select("key", "body").mapInPandas(run, "kind int, ah long, ch long, key long, a int, b int")


def window_rows(wanted: DataFrame, window: int, period: int) -> DataFrame:
    """Hashes of the windows that hold an anchor of ``opens``; each start once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, body, opens in zip(pdf["key"], pdf["body"], pdf["opens"], strict=True):
                words, ends = _batch_words([body])
                n = int(ends[0])
                own = np.unique(np.asarray(opens, np.int64))
                lo, hi = np.maximum(own - period + 1, 0), np.minimum(own, n - window)
                starts = np.unique(ragged_take(lo, np.maximum(hi - lo + 1, 0)))
                if not len(starts):
                    continue
                w1 = run_hashes(words, starts, starts + window)
                w2 = run_hashes(words[::-1].copy(), n - starts - window, n - starts)
                lead, again = collapse(w1, w2)
                yield pd.DataFrame({"kind": 1, "w1": key, "w2": 0, "key": key, "a": starts[again]})
                yield pd.DataFrame({"kind": 0, "w1": w1[lead].view(np.int64), "w2": w2[lead].view(np.int64), "key": key, "a": starts[lead]})

    return wanted.mapInPandas(run, "kind int, w1 long, w2 long, key long, a int")


def covered_words(docs: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """``key``, ``a``, ``b``: runs of words that lie in repeated windows."""
    found = anchor_rows(docs, window, period)
    # One shuffle: known runs travel under their document's key and pass the marks untouched.
    seen = marked(found.withColumn("ch", F.when(F.col("kind") == 0, F.col("ch"))))
    left = F.when(F.col("kind") == 1, F.col("a")).otherwise(F.greatest(F.col("a") - F.lit(period - 1), F.lit(0)))
    kept = materialize(
        seen.where("kind = 1 or settled or open").select("kind", "key", "a", left.alias("left"), "b", "settled", "open"), "anchors"
    )
    runs = kept.where("kind = 1 or settled").select("key", F.col("left").alias("a"), "b")
    opens = kept.where("kind = 0 and open").groupBy("key").agg(F.collect_list("a").alias("opens"))
    wanted = docs.select("key", "body").join(opens.hint("shuffle_hash"), "key")
    by = Window.partitionBy("w1").orderBy("w2")
    windows = window_rows(wanted, window, period)
    windows = windows.withColumn("w2", F.when(F.col("kind") == 0, F.col("w2"))).withColumn(
        "again", F.coalesce(F.lag("w2").over(by) == F.col("w2"), F.lit(False)) | F.coalesce(F.lead("w2").over(by) == F.col("w2"), F.lit(False))
    )
    more = materialize(windows.where("kind = 1 or again").select("key", "a", (F.col("a") + F.lit(window)).alias("b")), "windows")
    return runs.unionAll(more)


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, with_text: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (and ``kept``) of every document."""
    rows = keyed(docs, doc_id, text)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, body, s, e in zip(pdf["doc_id"].astype("Int64"), pdf["body"], pdf["starts"], pdf["ends"], strict=True):
                words, kept, at = body.split(), [], 0
                for a, b in merge_runs(s, e) if s is not None else []:
                    kept += words[at:a]
                    at = b
                kept = b" ".join(kept + words[at:])
                n = len(kept.split())
                out.append((d, len(words), len(words) - n, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] * with_text)))
            got = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text])
            got["doc_id"] = got["doc_id"].astype("Int64")
            yield got

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return with_runs(rows, covered_words(rows, window, period)).select("doc_id", "body", "starts", "ends").mapInPandas(cut, schema)


#: The same answer in SQL, over a table ``documents``.
ORACLE = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS g FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW})),
again AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(0, {WINDOW}) t(k)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS text FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM split) ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""
