"""Documents read window by window from a stream: what a document's windows share is merged when it closes.

The state of a document holds the windows seen and, for each core name, the
first name and the longest content so far.  A document closes when all its
windows have come, or when the watermark passes its last event by ``patience``.
Then one row for each core name goes out and only a mark stays, for as long
again, against windows that come a second time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.functions.text import core_name

OUT = "doc string, core string, name string, content string, windows int, closed string"


def _rows(extracted: DataFrame) -> DataFrame:
    core = F.lower(core_name("name"))
    return extracted.select(F.col("doc").cast("string").alias("doc"), F.col("window").cast("int").alias("window"), F.col("total").cast("int").alias("total"), core.alias("core"), "name", F.coalesce("content", F.lit("")).alias("content"), F.col("at").cast("timestamp").alias("at"))


def merged_documents(stream: DataFrame, patience: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """A stream of ``doc``, ``window``, ``total``, ``name``, ``content``, ``at`` as rows of closed documents.

    A window without a name still counts as seen (``name`` is null).  Repeated
    windows are taken once; rows of one window come in one micro-batch.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        doc = key[0]
        held = json.loads(state.get[0]) if state.exists else {"seen": [], "names": {}, "total": None, "last": 0, "closed": False}
        out = []

        def close(how: str) -> None:
            for core, (name, content, count) in sorted(held["names"].items()):
                out.append((doc, core, name, content, count, how))
            held.update(names={}, closed=True)

        if state.hasTimedOut:
            if not held["closed"]:
                close("expired")
                held["last"] += wait
            else:
                state.remove()
                yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
                return
        for pdf in batches:
            if pdf.empty:  # a timeout brings no rows
                continue
            held["last"] = max(held["last"], int(pdf["at"].max().timestamp() * 1000))
            for window, rows in pdf.groupby("window", sort=True):
                if held["closed"] or int(window) in held["seen"]:
                    continue
                held["seen"].append(int(window))
                totals = rows["total"].dropna()
                if len(totals):
                    held["total"] = int(totals.max())
                for core, own in rows.dropna(subset=["name"]).sort_values(["name", "content"]).groupby("core", sort=True):
                    best = max(own["content"], key=lambda c: (len(c), c))
                    name, content, count = held["names"].get(core, (own["name"].iloc[0], "", 0))
                    held["names"][core] = (min(name, own["name"].iloc[0]), max(content, best, key=lambda c: (len(c), c)), count + 1)
        if not held["closed"] and held["total"] is not None and len(held["seen"]) >= held["total"]:
            close("complete")
        state.update((json.dumps(held),))
        state.setTimeoutTimestamp(max(held["last"] + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    rows = _rows(stream).withWatermark("at", lateness)
    return rows.groupBy("doc").applyInPandasWithState(fold, OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def merged_batch(extracted: DataFrame) -> DataFrame:
    """The same answer over a table of whole documents, each closed: complete if all its windows are there."""
    rows = _rows(extracted)
    seen = rows.groupBy("doc").agg(F.countDistinct("window").alias("seen"), F.max("total").alias("total"))
    named = rows.where("name is not null")
    one = named.groupBy("doc", "core").agg(F.min("name").alias("name"), F.max_by("content", F.struct(F.length("content"), "content")).alias("content"), F.countDistinct("window").cast("int").alias("windows"))
    how = F.when(F.col("seen") >= F.col("total"), "complete").otherwise("expired")
    return one.join(seen, "doc").select("doc", "core", "name", "content", "windows", how.alias("closed"))


def first_mentions(closed: DataFrame) -> DataFrame:
    """Of each core name the first closed document by id, for linking documents that tell of the same thing."""
    by = Window.partitionBy("core").orderBy("doc")
    return closed.withColumn("_r", F.row_number().over(by)).where("_r = 1").select("core", "doc")
