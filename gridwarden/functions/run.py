"""Runs an operator's SQL on DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dialect import SPARK, Dialect

Operator = Callable[..., str]


def apply(operator: Operator, spark: SparkSession | None = None, **inputs: DataFrame) -> DataFrame:
    """The operator's result over DataFrames by the names of its inputs: apply(score.decay, cases=df)."""
    spark = spark or next(iter(inputs.values())).sparkSession
    return sql(spark, operator(SPARK, **{k: SPARK.table(k) for k in inputs}), inputs)


def sql(spark: SparkSession, text: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """Spark SQL in which relations are marked by SPARK.table()."""
    used = set(re.findall("\x01(\\w+)\x02", text))
    text = text.replace("{", "{{").replace("}", "}}").replace("\x01", "{").replace("\x02", "}")
    return spark.sql(text, **{k: inputs[k] for k in used})


#: What the operators group the driver's tables by.
KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
#: At the end of a table's name: with row_place, where a row stands in the table's files, in order of their names.
PLACED = "_placed"


def spread(df: DataFrame, key: str | None) -> DataFrame:
    """A table that is stored in fewer parts than there are cores, dealt out by its key: rows that say little on disk may stand for much work. Larger ones are read as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if key and df.rdd.getNumPartitions() < cores else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, dealt out if it is stored in few parts; where it was read from stays known if the name asks for it."""
    table = name.removesuffix(PLACED)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table != name:
        df = df.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("row_place"))
    return spread(df, KEYS.get(table))


def over_tables(build: Callable[[Dialect], str]) -> Callable[[SparkSession, str], DataFrame]:
    """A query over the driver's tables: build(dialect) names them by dialect.table()."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = build(SPARK)
        names = set(re.findall("\x01(\\w+)\x02", text))
        return sql(spark, text, {n: read(spark, sf_dir, n) for n in names})

    return query
