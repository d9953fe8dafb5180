"""A scan that counts itself: what goes into and comes out of each stage, noted by the run that makes the result, not by running stages again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.run import apply
from ..functions.tables import forget, written
from . import flow, scan, taint
from . import lines as L

STAGES = "stage string, place int, rows_in long, rows_out long"


def _counted(df: DataFrame, what: str, **more) -> tuple[DataFrame, dict]:
    """The table of df, written once, and counts of its rows that were taken while it was."""
    seen = Observation(what)
    table = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in more.items())), what)
    return table, seen.get


def scan_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts of files (doc_id, code), and a row of STAGES for each stage of this run: lines that can run, tainted names, findings of all parts and those that are the first of their line, documents with a verdict.

    Every table that several stages read is written once, and counted as it is.
    """
    spark: SparkSession = files.sparkSession
    source, n_files = _counted(files.select("doc_id", "code"), "files")
    parsed, n_lines = _counted(apply(L.parse, files=source), "lines")
    flagged, n_live = _counted(apply(flow.flagged, lines=parsed), "flagged", live=F.count_if(~F.col("dead")))
    seeds, n_seeds = _counted(apply(flow.seeds, lines=flagged), "seeds")
    edges, _ = _counted(apply(flow.edges, lines=flagged), "edges")
    names, n_names = _counted(taint.closure(seeds, edges), "names")
    found, n_found = _counted(apply(scan.findings, files=source, lines=flagged, tainted=names), "findings", documents=F.count_if(F.col("seq") == 1), severe=F.count_if(F.col("severity") == "high"))
    verdicts, n_verdicts = _counted(apply(scan.verdicts, found=found), "verdicts", passed=F.count_if("gate_pass"))
    told = [
        ("parse", n_files["rows"], n_lines["rows"]), ("live lines", n_lines["rows"], n_live["live"]), ("taint", n_seeds["rows"], n_names["rows"]), ("findings", n_live["live"], n_found["rows"]), ("severe", n_found["rows"], n_found["severe"]),
        ("documents", n_files["rows"], n_found["documents"]), ("verdicts", n_found["documents"], n_verdicts["rows"]), ("gate", n_verdicts["rows"], n_verdicts["passed"]),
    ]
    forget(source, parsed, flagged, seeds, edges, names, found)
    return verdicts, spark.createDataFrame([(s, i, a, b) for i, (s, a, b) in enumerate(told)], STAGES)


def summary(stages: DataFrame) -> DataFrame:
    """One line of text of a run."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("place", "stage", "rows_in", "rows_out"))), lambda s: F.concat(s.stage, F.lit(" "), s.rows_in.cast("string"), F.lit(" > "), s.rows_out.cast("string")))
    return stages.agg(F.array_join(each, "; ").alias("summary"))
