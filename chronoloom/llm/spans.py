"""Parts that the operators on repeated passages share: document keys, group marks and removal.

A passage operator emits anchors (``ah``: hash of the anchor, ``ch``: hash of
the context in which a match around it can lie).  Anchors of one context that
occurs twice are settled at once: all of the context is repeated.  Where an
anchor has several contexts, one row of each is looked at more closely.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.plans.materialize import materialize


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``doc_id``, ``body`` (UTF-8): the key is the id, or a written row number where ids repeat or are null."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))
    twice = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if twice.isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "body")
    return materialize(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "body"), "keyed")


def collapse(ah: np.ndarray, ch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For one batch: which rows stand for their context, and which contexts occur twice here.

    Returned as a mask of the first row of each (anchor, context) and a mask of
    the rows whose context is repeated, so that a crowded context leaves a batch
    as one row.
    """
    order = np.lexsort((ch, ah))
    a, c = ah[order], ch[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(new) - 1
    often = np.bincount(group, minlength=1)[group] > 1 if len(order) else np.zeros(0, bool)
    first, repeated = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[new]] = True
    repeated[order] = often
    return first, repeated


def marked(anchors: DataFrame) -> DataFrame:
    """Adds ``settled`` (its context occurs twice) and ``open`` (a first row whose anchor has several contexts)."""
    by = Window.partitionBy("ah")
    run = by.orderBy("ch")
    same = (F.lag("ch").over(run) == F.col("ch"), F.lead("ch").over(run) == F.col("ch"))
    return (
        anchors.withColumn("before", F.coalesce(same[0], F.lit(False)))
        .withColumn("after", F.coalesce(same[1], F.lit(False)))
        .withColumn("lowest", F.min("ch").over(by))
        .withColumn("highest", F.max("ch").over(by))
        .withColumn("settled", F.col("before") | F.col("after"))
        .withColumn("open", ~F.col("before") & (F.col("lowest") != F.col("highest")))
        .drop("before", "after", "lowest", "highest")
    )


def gathered(covered: DataFrame) -> DataFrame:
    """``key`` with arrays of its covered runs."""
    return covered.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("runs")).select(
        "key", F.col("runs.a").alias("starts"), F.col("runs.b").alias("ends")
    )


def with_runs(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """Every document with its covered runs; the narrow side is hashed, so the texts aren't sorted."""
    return docs.join(gathered(covered).hint("shuffle_hash"), "key", "left")
