"""Timelines, samples, suppressions and their log over scans, in versions; trusted patterns; the serialised form."""

import pytest
from pyspark.sql import functions as F

from gridwarden.sources import state
from gridwarden.sources.snapshots import Conflict

ISSUES = "repo string, title string, category string, severity string, confidence double"


def scan(spark, *rows):
    return spark.createDataFrame(list(rows), ISSUES)


def lines(tables):
    return {(r.repo, r.key): (r.severity, r.first_seen, r.last_seen, r.seen_count, r.status, r.resolved_at) for r in tables["timelines"].collect()}


def test_scans_over_versions(spark, tmp_path):
    path = str(tmp_path / "refined")
    tables, version = state.load_store(spark, path)
    assert version == 0 and all(t.count() == 0 for t in tables.values())
    tables = state.record_issues(tables, scan(spark, ("a", "SQL  Injection", "security", "high", 0.9), ("a", "Leak", "perf", "low", None), ("b", "Leak", "perf", "low", 0.5)), 100)
    assert state.save_store(spark, path, tables, version) == 1
    tables, version = state.load_store(spark, path)
    assert lines(tables) == {("a", "sql-injection:security"): ("high", 100, 100, 1, "active", None), ("a", "leak:perf"): ("low", 100, 100, 1, "active", None), ("b", "leak:perf"): ("low", 100, 100, 1, "active", None)}
    # twice in one scan, with another severity; the leak of a is resolved, b was not scanned
    tables = state.record_issues(tables, scan(spark, ("a", "sql injection", "security", "low", 0.7), ("a", "SQL injection", "security", "low", 0.6)), 200)
    state.save_store(spark, path, tables, version)
    tables, version = state.load_store(spark, path)
    assert lines(tables) == {("a", "sql-injection:security"): ("high", 100, 200, 3, "active", None), ("a", "leak:perf"): ("low", 100, 100, 1, "resolved", 200), ("b", "leak:perf"): ("low", 100, 100, 1, "active", None)}
    # back again; a resolution stays as it was told first
    tables = state.record_issues(tables, scan(spark, ("a", "leak", "perf", "high", 0.2)), 300)
    state.save_store(spark, path, tables, version)
    tables, version = state.load_store(spark, path)
    got = lines(tables)
    assert got["a", "leak:perf"] == ("low", 100, 300, 2, "active", None) and got["a", "sql-injection:security"][-2:] == ("resolved", 300)
    with pytest.raises(Conflict):
        state.save_store(spark, path, tables, 1)
    # suppressions with their log, beside tables that stay where they are
    sup = state.add_suppression(tables["suppressions"], "leak", "known", "me", 300)
    log = tables["audit"].unionByName(spark.createDataFrame([(300, "add", "sup-300", "me", None)], state.REFINED["audit"]))
    state.save_store(spark, path, {**tables, "suppressions": sup, "audit": log}, version)
    tables, _ = state.load_store(spark, path)
    assert tables["suppressions"].first().pattern == "leak" and tables["audit"].count() == 1 and lines(tables) == got


def test_samples_are_the_last_ones(spark):
    tables = {k: spark.createDataFrame([], s) for k, s in state.REFINED.items()}
    for k in range(4):
        tables = state.record_issues(tables, scan(spark, ("a", "x", "c", "low", k / 10), ("b", "x", "c", "low", None)), k, samples=3)
    assert sorted(r.confidence for r in tables["samples"].where("repo = 'a'").collect()) == [0.1, 0.2, 0.3]
    assert {r.confidence for r in tables["samples"].where("repo = 'b'").collect()} == {0.75}


def test_serialised_and_back(spark):
    tables = {k: spark.createDataFrame([], s) for k, s in state.REFINED.items()}
    tables = state.record_issues(tables, scan(spark, ("a", 'q"uote', "c", "low", None), (None, None, None, None, 0.1)), 5)
    told = state.serialize(tables)
    bad = spark.createDataFrame([("timelines", "{broken"), ("unknown", "{}")], "part string, value string")
    back = state.deserialize(told.unionByName(bad), state.REFINED)
    for k in state.REFINED:
        assert sorted(map(tuple, back[k].collect()), key=repr) == sorted(map(tuple, tables[k].collect()), key=repr), k


def test_trusted_patterns(spark):
    none = spark.createDataFrame([], state.TRUST)
    one = state.add_trust_pattern(none, "r", "trusted|sandbox", "ours", 7)
    assert [tuple(r) for r in one.collect()] == [("r", 7, "trust", "trusted|sandbox", "ours", None)]
    with pytest.raises(ValueError, match="no valid pattern"):
        state.add_trust_pattern(one, "r", "user (input", "odd", 8)
    with pytest.raises(ValueError, match="already"):
        state.add_trust_pattern(one, "r", "trusted|sandbox", "again", 9)
    assert state.add_trust_pattern(one, "s", "trusted|sandbox", "theirs", 9).where(F.col("repo") == "s").count() == 1
