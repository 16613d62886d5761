"""A training corpus from raw documents: the stages, in order, over whole tables.

Every stage reads what the stage before it kept, from Parquet.  A document's
columns pass through; the last stage returns the token shards' records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, mixing, simhash, tokens, toxicity
from chronoloom.llm.common import small_batches, table
from chronoloom.plans.materialize import materialize

#: Share of the tokens that reach the mixing stage which it keeps, each at most once.
BUDGET_SHARE, MAX_EPOCHS = 0.95, 1


def named(docs: DataFrame) -> list[Column]:
    """The columns of documents, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject.

    Null and empty texts are scored as a text without words; rows that repeat an
    id or have none are judged each; without labels of both classes nothing is
    rejected unless toxic labels prevail; an empty table stays empty; all columns pass.
    """
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key, under a name of its own: the id, or a written row number where ids repeat or are null."""
    key = "_row"
    while key in docs.columns:
        key = f"_{key}"
    twice = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if twice.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near-duplicates.

    Rows without an id come last; rows that share an id are rows of their own,
    which stay unless they are near-duplicates; of repeated rows one stays; null
    and empty texts are near-duplicates of each other; an empty table stays empty.
    """
    small_batches(spark)
    rows, key = numbered(docs)
    groups = simhash.near_duplicates(rows, doc_id=key).select(F.col("doc_id").alias(key), "component_id")
    members = groups.join(rows.select(key, "doc_id"), key)
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first")).select(f"first.{key}")
    return rows.join(first.hint("shuffle_hash"), key, "left_semi").select(*named(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item.

    Every row is judged by itself, also where ids repeat or are null; null and
    empty texts hold nothing and stay; without items all rows stay.
    """
    small_batches(spark)
    rows, key = numbered(docs)
    found = decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), doc_id=key)
    bad = materialize(found.where("contaminated").select(F.col("doc_id").alias(key)), "contaminated")
    return rows.join(bad, key, "left_anti").select(*named(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The seeded prefix of every source's documents that its budget allows.

    Null languages and sources are leaves of their own; null and empty texts
    cost nothing and follow their place in the order; rows that repeat an id are
    counted each; an empty table stays empty.
    """
    return mixing.mixed(docs, budget_share=BUDGET_SHARE, max_epochs=MAX_EPOCHS).select(*named(docs))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of what is left, and each document's place in them.

    A null or empty text is its end id alone; rows without an id come first and
    rows that repeat one follow each other; an empty table gives no rows.
    """
    small_batches(spark)
    return tokens.token_round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("token shards", write_tokens),
]

#: A trained model, a hash sketch and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage{i}")
    return docs
