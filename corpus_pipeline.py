"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Toxic documents go, one document of
each near-duplicate group stays, contaminated documents go and benchmark passages are cut out of the others, personal data is replaced by its kind, and what is left is encoded.
All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwarden.llm import decontamination, pii, sentencepiece_codec, simhash, toxicity
from gridwarden.llm.common import read, shared_dir
from gridwarden.llm.queries import piece_model

#: Some stages have no form in SQL.
ORACLE_SQL = None
#: Benchmark passages of so many words are cut out of documents that stay: all that the query finds.
CUT_WORDS = decontamination.WINDOW
#: Documents that go to Python at a time: some MB of text, where the usual number is ten times that in every task, on both sides.
BATCH_ROWS = 1000


def _in_small_batches(spark: SparkSession) -> None:
    """From now on in this session: stages are run after they are returned, so it can't be set for one alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that score 0.5 or more; the model learns from the same folds as the query."""
    _in_small_batches(spark)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), usable=toxicity.fold("id", 5) != 0)
    names = [f"c{i}" for i in range(len(docs.columns))]
    scored = toxicity.score_documents(docs.toDF(*names), model, names[docs.columns.index("text")])
    return scored.where("predicted = 0").select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; shingles of five words, similarity 0.8 or more."""
    _in_small_batches(spark)
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the rule of the query calls contaminated; spans of CUT_WORDS words or more are cut out of the others, and n_chars follows."""
    _in_small_batches(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = decontamination.find_windows(docs.toDF(*names), read(spark, sf_dir, "benchmark"), text, cut_words=CUT_WORDS)
    clean = found.where(~decontamination.contaminated(F.col("n_hit"), F.col("n_words")))
    made = {"text": F.coalesce("left", text), "n_chars": F.when(F.col("n_cut") > 0, F.length("left")).otherwise(F.col(names[docs.columns.index("n_chars")])).cast("long") if "n_chars" in docs.columns else None}
    return clean.select(*(made[c].alias(c) if made.get(c) is not None else F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, plain or disguised, give way to their kind. A null text stays null."""
    _in_small_batches(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    found = pii.scan(docs.toDF(*names), text, redacted=True)
    new = F.when(F.col(text).isNotNull(), F.col("redacted"))
    made = {"text": new, "n_chars": F.when(F.size("spans") > 0, F.length("redacted")).otherwise(F.col(names[docs.columns.index("n_chars")])).cast("long") if "n_chars" in docs.columns else None}
    return found.select(*(made[c].alias(c) if made.get(c) is not None else F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with begin and end, and hashes of the ids and of the text that they decode to."""
    _in_small_batches(spark)
    made = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    return sentencepiece_codec.encode_documents(docs.select("doc_id", "text"), piece_model(), keep=["doc_id"], made=made)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_dir(spark).rstrip('/')}/gridwarden/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
