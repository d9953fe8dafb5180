"""State kept between scans as partitioned tables, and reports written from scans.

A repository is a partition; saving a scan replaces the partitions that it has and leaves all others.
"""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.run import apply
from ..functions.tables import written
from ..operators import history
from .snapshots import Store

MEMORY = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("seen_count", T.LongType()), T.StructField("absent_scans", T.LongType()), T.StructField("confirmed_fp", T.BooleanType()),
    T.StructField("suppressed", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("escalated", T.BooleanType()), T.StructField("repo", T.StringType()),
])
TRUST = T.StructType([T.StructField(n, t) for n, t in (("repo", T.StringType()), ("pos", T.LongType()), ("kind", T.StringType()), ("pattern", T.StringType()), ("reason", T.StringType()), ("expires_at", T.LongType()))])
#: What is kept of findings over scans besides memory: tables by name, each a versioned store's.
REFINED = {
    "suppressions": "id string, pos long, pattern string, reason string, approved_by string, expires_at long",
    "audit": "happened long, action string, id string, who string, note string",
    "timelines": "repo string, key string, title string, category string, severity string, first_seen long, last_seen long, resolved_at long, seen_count long, status string",
    "samples": "repo string, key string, title string, at long, confidence double, severity string",
}
SUPPRESSIONS = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("pos", T.LongType()), ("pattern", T.StringType()), ("reason", T.StringType()), ("approved_by", T.StringType()), ("expires_at", T.LongType()))])


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_memory(spark: SparkSession, path: str) -> DataFrame:
    """What is remembered of all repositories; nothing where nothing was saved."""
    return spark.read.schema(MEMORY).parquet(path) if _there(spark, path) else spark.createDataFrame([], MEMORY)


def save_memory(memory: DataFrame, path: str) -> None:
    memory.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(path)


def record_scan(spark: SparkSession, path: str, scan: DataFrame) -> DataFrame:
    """Puts a scan, (repo, key, severity, n), into memory and returns the state of its repositories."""
    known = load_memory(spark, path).select("repo", "key", "seen_count", "absent_scans", "confirmed_fp", "suppressed")
    after = apply(history.remember, memory=known, scan=scan).select(*MEMORY.names)
    # read and replaced at one path: the rows are cut loose from what they come from first
    after = written(after, "memory")
    save_memory(after, path)
    return after


def mark_false_positive(spark: SparkSession, path: str, repo: str, key: str) -> None:
    rows = load_memory(spark, path).where(F.col("repo") == repo).withColumn("confirmed_fp", F.col("confirmed_fp") | (F.col("key") == key))
    save_memory(spark.createDataFrame(rows.toArrow(), MEMORY), path)  # one repository's keys


def add_suppression(suppressions: DataFrame, pattern: str, reason: str, approved_by: str, now: int, days: int = 90, ident: str | None = None) -> DataFrame:
    """With one more, which ends after so many days."""
    row = [(ident or f"sup-{now}", now, pattern, reason, approved_by, now + days * 86_400)]
    return suppressions.unionByName(suppressions.sparkSession.createDataFrame(row, SUPPRESSIONS))


def purge_suppressions(suppressions: DataFrame, now: int) -> DataFrame:
    return suppressions.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def check_pattern(spark: SparkSession, pattern: str) -> None:
    """Refuses what can't be used as a pattern, before anything is stored."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException as e:
        raise ValueError(f"no valid pattern: {pattern!r}") from e


def add_trust_pattern(approvals: DataFrame, repo: str, pattern: str, reason: str, now: int) -> DataFrame:
    """Approvals, rows of TRUST, with a trusted pattern of a repository more; it does not end. One that is there already, or is no pattern, is refused."""
    check_pattern(approvals.sparkSession, pattern)
    if approvals.where((F.col("repo") == repo) & (F.col("kind") == "trust") & (F.col("pattern") == pattern)).limit(1).count():
        raise ValueError(f"{repo} trusts {pattern!r} already")
    row = [(repo, now, "trust", pattern, reason, None)]
    return approvals.unionByName(approvals.sparkSession.createDataFrame(row, TRUST))


def load_store(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], int]:
    """The tables of REFINED in their newest version, and its number; empty ones and 0 where nothing was saved."""
    store = Store(spark, path)
    known, version = store.load(), store.latest()
    return {k: known[k] if k in known else spark.createDataFrame([], s) for k, s in REFINED.items()}, version


def save_store(spark: SparkSession, path: str, tables: dict[str, DataFrame], base: int) -> int:
    """Saves tables as the version after base; snapshots.Conflict if another came between. Tables as they were loaded are not written again."""
    return Store(spark, path).save({k: tables[k] for k in REFINED}, base)


def record_issues(tables: dict[str, DataFrame], issues: DataFrame, now: int, samples: int = history.SAMPLES) -> dict[str, DataFrame]:
    """Tables of REFINED after a scan, issues (repo, title, category, severity, confidence), at a time.

    A finding's timeline is extended or begun, with its first severity; findings of the scanned repositories that are not in the scan are resolved as of now. Its last samples of confidence stay. Other repositories are left as they are. A null repository, title or category counts as ''.
    """
    issues = issues.na.fill("", ["repo", "title", "category"])
    named = apply(lambda d, i: f"SELECT repo, {history.timeline_key(d)} AS key, title, category, severity, COALESCE(confidence, {d.num(0.75)}) AS confidence FROM {i} x", i=issues)
    order = F.struct("title", "category", "severity", "confidence")
    seen = named.groupBy("repo", "key").agg(F.min(order).alias("one"), F.count("*").alias("n"))
    seen = seen.select(F.col("repo").alias("r"), F.col("key").alias("k"), "one", "n")
    scanned = issues.select(F.col("repo").alias("scanned")).distinct()
    old = tables["timelines"].join(scanned, F.col("repo") == F.col("scanned"), "left")
    both = old.join(seen, (F.col("repo") == F.col("r")) & (F.col("key") == F.col("k")), "full")
    here, known, at = F.col("k").isNotNull(), F.col("key").isNotNull(), F.lit(now).cast("long")
    leaves = known & ~here & F.col("scanned").isNotNull() & (F.col("status") == "active")
    timelines = both.select(
        F.coalesce("repo", "r").alias("repo"), F.coalesce("key", "k").alias("key"), *(F.when(known, F.col(c)).otherwise(F.col(f"one.{c}")).alias(c) for c in ("title", "category", "severity")),
        F.when(known, F.col("first_seen")).otherwise(at).alias("first_seen"), F.when(here, at).otherwise(F.col("last_seen")).alias("last_seen"), F.when(leaves, at).when(~here, F.col("resolved_at")).alias("resolved_at"),
        (F.coalesce("seen_count", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("seen_count"), F.when(here, "active").when(leaves, "resolved").otherwise(F.col("status")).alias("status"),
    )
    drawn = tables["samples"].unionByName(named.select("repo", "key", "title", at.alias("at"), "confidence", "severity"))
    last = Window.partitionBy("repo", "key").orderBy(F.desc("at"), F.desc("confidence"), "severity")
    kept = drawn.withColumn("back", F.row_number().over(last)).where(F.col("back") <= samples).drop("back")
    return {**tables, "timelines": timelines, "samples": kept}


def serialize(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, value): the rows of some tables as lines of JSON, each with the name of its table; a form that other tools read."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def deserialize(lines: DataFrame, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables that serialize() told; lines that are no JSON, and parts without a schema, are left out, as a damaged store is read as far as it can be."""
    out = {}
    for name, schema in schemas.items():
        rows = lines.where(F.col("part") == name).withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
        out[name] = rows.where(F.get_json_object("value", "$").isNotNull()).select("row.*")
    return out


def report(findings: DataFrame) -> DataFrame:
    """One JSON text per document: its findings in order, and how many of each severity."""
    each = F.struct("seq", *(c for c in findings.columns if c not in ("doc_id", "seq", "code")))
    count = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s)
    rows = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("issues"), count("high"), count("medium"), count("low"))
    return rows.select("doc_id", F.to_json(F.struct("doc_id", F.struct("high", "medium", "low").alias("counts"), "issues")).alias("report"))


def write_report(findings: DataFrame, path: str) -> None:
    report(findings).select(F.col("report").alias("value")).write.mode("overwrite").text(path)


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as (doc_id, path, code), whole."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("code"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", "code")


def read_requests(requests: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Scan requests in JSON, sorted into accepted and refused with the reason."""
    models = ["openai/gpt-4o-mini", "openai/gpt-4o", "anthropic/claude-3-haiku", "anthropic/claude-3.5-sonnet", "meta-llama/llama-3.1-8b-instruct", "auto"]
    langs = ["auto", "javascript", "typescript", "python", "rust", "go", "java", "cpp", "csharp", "php", "ruby", "swift", "kotlin", "sql", "bash"]
    rows = requests.withColumn("r", F.from_json(body, "code string, model string, language string", {"mode": "PERMISSIVE"}))
    model, lang = F.coalesce("r.model", F.lit("auto")), F.coalesce("r.language", F.lit("auto"))
    why = (
        F.when(F.col("r").isNull() | F.col("r.code").isNull() & F.get_json_object(body, "$").isNull(), "invalid JSON")
        .when(F.coalesce(F.trim("r.code"), F.lit("")) == "", "no code")
        .when(~model.isin(models), "unknown model")
        .when(~lang.isin(langs), "unknown language")
    )
    told = rows.withColumns({"refused": why, "code": F.trim("r.code"), "model": model, "language": lang}).drop("r")
    return told.where("refused IS NULL").drop("refused"), told.where("refused IS NOT NULL").select(*requests.columns, "refused")
