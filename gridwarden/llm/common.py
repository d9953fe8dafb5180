"""Plumbing shared by the text operators.

Conventions that hold for every operator here:

* a null text counts as an empty one;
* rows are never merged, dropped or sampled unless the operator's purpose is to filter;
* only the id and text columns are read unless an operator says otherwise, so extra columns, whatever
  their names, neither disturb a result nor reach it;
* ids are opaque: they may be null or repeated, and every input row gets its own output row;
* where an operator keeps the input's columns, one named like a result, in any case, gives way to the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one call of an operator's kernel gets; a longer text comes alone.
SLICE_BYTES = 4 << 20

#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _word_table() -> bytes:
    """Lower-cases A-Z and turns every ASCII byte that is neither digit nor letter into a space."""
    table = bytearray(LOWER)
    for i in range(128):
        if not chr(i).isalnum():
            table[i] = 32
    return bytes(table)


WORDS = _word_table()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 text."""
    return text.translate(WORDS).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that no input column has, in any case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def without(columns: Iterable[str], results: Iterable[str]) -> list[str]:
    """The columns that no result is named like."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def slices(batches: Iterable[pa.RecordBatch], text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about SLICE_BYTES of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)).astype(np.int64)
        piece = np.cumsum(size) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


Kernel = Callable[[list[bytes]], list[pa.Array]]


def append_columns(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Kernel],
    fields: list[T.StructField],
    keep: list[str] | None = None,
) -> DataFrame:
    """Adds what a kernel computes from each text; one narrow pass, no shuffle.

    make() runs once per task and returns the kernel. keep: the input columns that stay, all by default.
    """
    keep = without(df.columns if keep is None else keep, (f.name for f in fields))
    inner = [f"c{i}" for i in range(len(keep))]
    source = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)), F.col(f"`{text_col}`").alias("body"))
    schema = T.StructType([T.StructField(n, source.schema[n].dataType) for n in inner] + [T.StructField(f"o{i}", f.dataType) for i, f in enumerate(fields)])
    names, k = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for piece in slices(batches, k):
            made = kernel(texts_of(piece.column(k)))
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(k)), *made], names=names)

    out = source.mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(inner, keep, strict=True)), *(F.col(f"o{i}").alias(f.name) for i, f in enumerate(fields)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where there is no cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
    return named or "/tmp/checkpoints"


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """The same rows as a table in the shared folder, in parts by a column if asked for: lineage ends there, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/gridwarden/{what}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._gridwarden_path = path
    return back


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    path = getattr(df, "_gridwarden_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def as_read(df: DataFrame) -> bool:
    """True if df is rows of files as they were read: columns and filters of one scan, nothing joined or made."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation" and bool(df.inputFiles())


def placed(df: DataFrame, what: str) -> DataFrame:
    """The columns as c0, c1 and on, and `file` and `place`, which tell every row apart.

    They are where a row stands in the files, however these are split into tasks, so that a task that runs again or a plan that is made anew has the same ones.
    Rows that come from elsewhere are written first.
    """
    rows = df if as_read(df) else written(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), what)
    named = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns)] if len({c.lower() for c in rows.columns}) == len(rows.columns) else None
    if named is None:  # names that clash can't be asked for by name
        rows = written(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), what)
        named = [F.col(c) for c in rows.columns]
    out = rows.select(*named, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    out._gridwarden_path = getattr(rows, "_gridwarden_path", None)
    return out


def small_enough(df: DataFrame, limit: int) -> bool:
    """True if df has at most limit rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit
