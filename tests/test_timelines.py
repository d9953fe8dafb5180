"""Timelines as a stream: scans, resolved findings, late rows, expiry, and a restart from its checkpoint."""

import datetime as dt

import pytest

from gridwarden.streaming.timelines import EXPIRE_DAYS, rocksdb, track_timelines

SCHEMA = "repo string, key string, severity string, confidence double, ts timestamp"


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


class Feed:
    """A stream of files, one batch of rows at a time, started anew for each batch: state comes from the checkpoint."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.n = spark, path, options, 0
        (path / "in").mkdir(parents=True)

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        got = []
        stream = track_timelines(self.spark.readStream.schema(SCHEMA).parquet(str(self.path / "in")), **self.options)
        with rocksdb(self.spark):
            query = stream.writeStream.outputMode("update").option("checkpointLocation", str(self.path / "progress")).trigger(availableNow=True).foreachBatch(lambda b, _: got.extend(b.collect())).start()
            query.awaitTermination()
        return {(r.repo, r.key): (r.severity, r.first_seen // 86_400_000 - 19723, r.last_seen // 86_400_000 - 19723, r.seen_count, r.status, r.resolved_at and r.resolved_at // 86_400_000 - 19723) for r in got}

    def kept(self):
        state = self.spark.read.format("statestore").option("stateVarName", "findings").load(str(self.path / "progress"))
        return sorted((r.key.repo, r.user_map_key.key) for r in state.collect())


@pytest.fixture
def spark2(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_scans_late_rows_and_expiry(spark2, tmp_path):
    feed = Feed(spark2, tmp_path / "a", lateness="3 days", expire_days=30)
    got = feed.put(("r", "sql", "high", 0.9, day(0)), ("r", "xss", "low", None, day(0)), ("q", "sql", "low", 0.5, day(0)))
    assert got == {("r", "sql"): ("high", 0, 0, 1, "active", None), ("r", "xss"): ("low", 0, 0, 1, "active", None), ("q", "sql"): ("low", 0, 0, 1, "active", None)}
    # a scan without xss resolves it; the first severity stays; the other repository is as it was
    got = feed.put(("r", "sql", "low", 0.8, day(2)))
    assert got == {("r", "sql"): ("high", 0, 2, 2, "active", None), ("r", "xss"): ("low", 0, 0, 1, "resolved", 2)}
    # late but not too late: counted, and no scan that resolves or brings back
    got = feed.put(("r", "xss", "low", 0.8, day(1)), ("r", "new", "low", 0.8, day(1)))
    assert got == {("r", "xss"): ("low", 0, 1, 2, "resolved", 2), ("r", "new"): ("low", 1, 1, 1, "resolved", 2)}
    # two scans in one batch: back, and gone again
    got = feed.put(("r", "xss", "high", 0.8, day(8)), ("r", "sql", "low", 0.8, day(9)))
    assert got[("r", "xss")] == ("low", 0, 8, 3, "resolved", 9) and got[("r", "sql")] == ("high", 0, 9, 3, "active", None)
    # too late: dropped
    assert feed.put(("r", "old", "low", 0.8, day(1))) == {}
    assert feed.kept() == [("q", "sql"), ("r", "new"), ("r", "sql"), ("r", "xss")]
    # a month on: what was not seen since goes, with a last row, and its state
    got = feed.put(("r", "sql", "low", 0.8, day(40)))
    assert {k: v[4] for k, v in got.items() if k != ("r", "sql")} == {("q", "sql"): "expired", ("r", "new"): "expired"}
    assert feed.kept() == [("r", "sql"), ("r", "xss")]
    got = feed.put(("q", "sql", "high", 0.1, day(42)))
    assert got[("q", "sql")] == ("high", 42, 42, 1, "active", None)
    got = feed.put(("q", "sql", "high", 0.1, day(100)))
    assert got[("r", "sql")][4] == "expired"
    assert feed.kept() == [("q", "sql")]


def test_samples_and_nulls(spark2, tmp_path):
    feed = Feed(spark2, tmp_path / "b", samples=3)
    assert EXPIRE_DAYS == 90
    rows = [(None, None, None, c, day(i)) for i, c in enumerate((0.9, 0.1, 0.3, 0.5))]
    got = feed.put(*rows, ("x", "k", "low", 0.2, None))
    assert got == {("", ""): (None, 0, 3, 4, "active", None)}
    state = spark2.read.format("statestore").option("stateVarName", "findings").load(str(tmp_path / "b/progress")).collect()
    assert [round(x, 6) for x in state[0].user_map_value.samples] == [0.1, 0.3, 0.5]
