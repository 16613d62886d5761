"""Sources and sinks: versioned tables by graph, documents, JSON caches, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.sources.schemas import TABLES


class Graph:
    """A folder of append-only Parquet tables, partitioned by the namespace of the graph."""

    def __init__(self, spark: SparkSession, root: str, graph_id: str = "default"):
        self.spark, self.root, self.graph_id = spark, root.rstrip("/"), graph_id

    def read(self, name: str) -> DataFrame:
        """A table of this graph only: the namespace prunes partitions before any file is opened."""
        schema = f"{TABLES[name]}, graph_id string"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").where(F.col("graph_id") == self.graph_id).drop("graph_id")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; columns that the rows lack are null."""
        empty = self.spark.createDataFrame([], TABLES[name])
        known = [c for c in rows.columns if c in empty.columns]
        full = empty.unionByName(rows.select(*known), allowMissingColumns=True).withColumn("graph_id", F.lit(self.graph_id))
        full.write.mode("append").partitionBy("graph_id").parquet(f"{self.root}/{name}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 files: ``path``, ``text``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def list_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with size and time; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "modificationTime")


def write_doc_folders(docs: DataFrame, path: str, text: str = "text") -> None:
    """One folder for each document hash."""
    docs.withColumn("doc_hash", F.substring(F.md5(F.col(text).cast("binary")), 1, 12)).write.mode("append").partitionBy("doc_hash").json(path)


def write_extraction(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_extraction(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def dot_lines(edges: DataFrame, left: str = "u", right: str = "v", label: str | None = None) -> DataFrame:
    """Graphviz statements of undirected edges, one for each line; the caller frames them in ``graph { }``."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c.cast("string"), '(["\\\\])', "\\\\$1"), F.lit('"'))
    tail = F.concat(F.lit(" [label="), quote(F.col(label)), F.lit("]")) if label else F.lit("")
    return edges.select(F.concat(F.lit("  "), quote(F.col(left)), F.lit(" -- "), quote(F.col(right)), tail, F.lit(";")).alias("value"))


def markdown_lines(entities: DataFrame) -> DataFrame:
    """A Markdown section for each entity."""
    return entities.select(F.concat(F.lit("## "), F.coalesce("name", F.lit("")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("value"))


def export(rows: DataFrame, path: str, kind: str = "json") -> None:
    """JSON lines of any rows, or text of rows with one ``value`` column."""
    (rows.write.mode("overwrite").json if kind == "json" else rows.write.mode("overwrite").text)(path)
