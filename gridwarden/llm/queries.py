"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, license_scan, line_dedup, lm_scoring, merkle_manifest, periodic_runs, pii, quality_classifier, quality_rules, secret_scan, sentencepiece_codec, simhash, toxicity
from .common import read


def piece_model() -> str:
    """Where the public vocabulary is; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return sentencepiece_codec.encode_documents(docs, piece_model(), keep=["doc_id"], made=("n_tokens", "ids_sha256", "decoded_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, usable=toxicity.fold("id", 5) != 0)
    out = toxicity.score_documents(docs, model, keep=["doc_id"], locate=True)
    spans = F.array_join(F.transform("sentences", lambda x: F.concat_ws(":", x.start.cast("string"), x.end.cast("string"))), ",")
    return out.select("doc_id", F.coalesce(toxicity.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", spans.alias("sentences"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of good quality. Background: all."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    models = lm_scoring.fit(docs, labels.where("quality = 1"))
    return lm_scoring.score_documents(docs, models, keep=["doc_id"])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(read(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.group_documents(read(spark, sf_dir, "documents"), width=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels, usable=toxicity.fold("id", 3) != 1)
    out = quality_classifier.score_documents(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(toxicity.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    told = lambda x: F.concat_ws(":", x.label, x["first"].cast("string"), x["last"].cast("string"))
    return out.withColumn("spans", F.array_join(F.transform("notices", told), ",")).drop("notices")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    names = F.array(*map(F.lit, pii.NAMES))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)),
        F.sha2(text(F.filter("spans", lambda x: x.kind < 4)).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = decontamination.find_windows(docs, items, keep=["doc_id"], cut_words=decontamination.WINDOW)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        "n_cut",
        F.sha2(F.col("left").cast("binary"), 256).alias("left_sha256"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), keep=["doc_id"]).drop("n_removed")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_shared_lines(read(spark, sf_dir, "documents"), keep=["doc_id"], made=("n_lines", "n_dropped", "kept_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return periodic_runs.collapse_runs(docs, keep=["doc_id"], made=periodic_runs.NAMES[:7], echo=periodic_runs.planted())


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.prove(read(spark, sf_dir, "documents"), now=merkle_manifest.tampered()).drop("path")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_toxicity, op3_lm_scoring, op4_secret_scan, op5_simhash, op6_quality_classifier, op7_license_scan, op8_pii, op9_decontamination, op10_quality_rules,
        op11_line_dedup, op12_periodic_runs, op13_merkle_manifest, pipeline,
    )
}
ORACLES = {"op11_line_dedup": line_dedup.oracle_sql(), "op13_merkle_manifest": merkle_manifest.oracle_sql()}
