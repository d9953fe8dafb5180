"""Tables in the folder that all executors share: state between scans, and results that several readers use."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where there is no cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
    return (named or "/tmp/checkpoints").rstrip("/") + "/gridwarden"


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows as a table there."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._gridwarden_path = path
    return back


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gridwarden_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
