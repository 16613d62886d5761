"""Structured Streaming: idempotent ingest, rolling metrics, evidence folded by pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.operators.dream import CORROBORATED, PROMOTE_AT, PROMOTED, STEP


def ingest(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a batch function on every micro-batch; a batch that is replayed has the same number."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_once(path: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A step that writes each batch to a folder of its own number, so that a replay replaces it."""

    def step(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def rolling_metrics(requests: DataFrame, window: str = "5 minutes", slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Count, error share and latency of each window; late rows beyond the watermark are closed out."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    marked = requests.withWatermark("ts", lateness).groupBy(span, "event_type")
    return marked.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "event_type", "n", "mean", "most")


def corroboration(stream: DataFrame) -> DataFrame:
    """Evidence rows (``pair``, ``at``) folded by pair in time order: count, confidence, status."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, confidence, status = state.get if state.exists else (0, 0.5, "hypothesized")
        for pdf in batches:
            for _ in range(len(pdf)):
                count += 1
                confidence = max(PROMOTED, confidence) if status == "verified" else min(confidence + STEP, CORROBORATED)
                if status == "hypothesized" and count >= PROMOTE_AT:
                    status, confidence = "verified", max(confidence, PROMOTED)
        state.update((count, confidence, status))
        yield pd.DataFrame({"pair": [key[0]], "count": [count], "confidence": [round(confidence, 6)], "status": [status]})

    return stream.groupBy("pair").applyInPandasWithState(
        fold, "pair string, count long, confidence double, status string", "count long, confidence double, status string", "update", GroupStateTimeout.NoTimeout
    )
