"""Lineage cuts that survive lost executors: written tables in the cluster's shared folder.

The folder is the one named by ``spark.checkpoint.dir``.  Only where that
setting is absent and Spark runs in one process (tests, notebooks) a folder is
chosen here; on a cluster the setting is required.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh shared folder, deleted when the session's JVM ends."""
    uri = f"{shared_root(spark)}/chronoloom/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return uri


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans restart from files, not lineage."""
    spark = df.sparkSession
    uri = f"{new_folder(spark, name)}/t"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(uri)
    return spark.read.schema(df.schema).parquet(uri)
