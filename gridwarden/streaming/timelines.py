"""Timelines of findings as a stream of scans, in state that forgets: a map of findings for each repository, with timers that take out what was not seen for so long.

A row is a finding of a scan; rows of one repository and time are one scan. Per finding there is kept when it was first and last seen, how often, its first severity, whether the repository's newest scan has it
(else it is resolved, as of that scan), and the last samples of its confidence. State is in RocksDB, a finding an entry of its own, so that a repository may have more findings than memory holds.

Time is that of the rows. Rows older than the watermark, the newest row less `lateness`, are dropped by Spark. Rows that are late but not so late count as seen, may move the first sight back, and leave the status to newer scans.
A finding not seen for `expire_days` before the watermark goes, with a last row of status 'expired'; seen again, it is new. A repository without findings leaves no state.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .stateful import drift

DAY_MS, SAMPLES, EXPIRE_DAYS = 86_400_000, 20, 90
OUT = "repo string, key string, severity string, first_seen long, last_seen long, seen_count long, status string, resolved_at long, slope double, label string"
_STATE = "severity string, first_seen long, last_seen long, seen_count long, status string, resolved_at long, samples array<double>"
_FIELDS = ("severity", "first_seen", "last_seen", "seen_count", "status", "resolved_at", "samples")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timelines(StatefulProcessor):
    """Keyed by repository; times in milliseconds."""

    def __init__(self, samples: int, expire_ms: int):
        self.samples, self.expire_ms = samples, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.findings = handle.getMapState("findings", "key string", _STATE)
        self.newest = handle.getValueState("newest", "at long")
        self.alarm = handle.getValueState("alarm", "at long")

    def _told(self, repo: str, rows: dict[str, dict]) -> Iterator[pd.DataFrame]:
        if rows:
            moved = {k: drift(list(s["samples"])) for k, s in rows.items()}
            yield pd.DataFrame(
                [{"repo": repo, "key": k, **{f: s[f] for f in _FIELDS[:6]}, "slope": moved[k][0], "label": moved[k][1]} for k, s in sorted(rows.items())],
                columns=["repo", "key", *_FIELDS[:6], "slope", "label"],
            ).astype({"resolved_at": "Int64"})

    def _get(self, key: str) -> dict | None:
        value = self.findings.getValue((key,)) if self.findings.containsKey((key,)) else None
        return None if value is None else dict(zip(_FIELDS, value, strict=True))

    def _put(self, key: str, s: dict) -> None:
        self.findings.updateValue((key,), tuple(s[f] for f in _FIELDS))

    def _set_alarm(self, at: int) -> None:
        """One timer for a repository, at the earliest time that a finding may expire."""
        known = self.alarm.get()[0] if self.alarm.exists() else None
        if known == at:
            return
        if known is not None:
            with contextlib.suppress(Exception):  # it may have fired just now
                self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        scans: dict[int, list[tuple]] = {}
        for batch in rows:
            for at, name, severity, confidence in zip(batch["at"], batch["key"], batch["severity"], batch["confidence"], strict=True):
                scans.setdefault(int(at), []).append((name, severity, float(confidence)))
        newest = self.newest.get()[0] if self.newest.exists() else -1
        touched: dict[str, dict] = {}
        for at in sorted(scans):
            here = scans[at]
            for name, severity, confidence in sorted(here, key=lambda r: (r[0], r[1] or "", r[2])):
                s = touched.get(name) or self._get(name)
                if s is None:
                    s = {"severity": severity, "first_seen": at, "last_seen": at, "seen_count": 0, "status": "active" if at >= newest else "resolved", "resolved_at": None if at >= newest else newest, "samples": []}
                s["first_seen"], s["last_seen"] = min(s["first_seen"], at), max(s["last_seen"], at)
                s["seen_count"] += 1
                s["samples"] = [*s["samples"], confidence][-self.samples :]
                if at >= newest:
                    s["status"], s["resolved_at"] = "active", None
                touched[name] = s
            if at >= newest:
                names = {n for n, _, _ in here}
                known = {k[0]: v for k, v in self.findings.iterator() if k[0] not in touched and v[4] == "active"} if at > newest else {}
                for k, v in known.items():
                    touched[k] = dict(zip(_FIELDS, v, strict=True))
                for k, s in touched.items():
                    if k not in names and s["status"] == "active" and at > s["last_seen"]:
                        s["status"], s["resolved_at"] = "resolved", at
                newest = at
        for name, s in touched.items():
            self._put(name, s)
        self.newest.update((newest,))
        first = min([s["last_seen"] for s in touched.values()], default=newest) + self.expire_ms
        known = self.alarm.get()[0] if self.alarm.exists() else first
        self._set_alarm(max(min(first, known), timerValues.getCurrentWatermarkInMs() + 1))
        yield from self._told(key[0], touched)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        gone, left = {}, None
        for k, v in list(self.findings.iterator()):
            s = dict(zip(_FIELDS, v, strict=True))
            if s["last_seen"] + self.expire_ms <= mark:
                gone[k[0]] = {**s, "status": "expired"}
            else:
                left = min(s["last_seen"], left if left is not None else s["last_seen"])
        for k in gone:
            self.findings.removeKey((k,))
        self.alarm.clear()
        if left is None:
            self.findings.clear()
            self.newest.clear()
        else:
            self._set_alarm(left + self.expire_ms)
        yield from self._told(key[0], gone)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, as state of several kinds needs it."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def track_timelines(findings: DataFrame, lateness: str = "1 day", expire_days: int = EXPIRE_DAYS, samples: int = SAMPLES) -> DataFrame:
    """Changes of timelines, as rows of OUT, from findings (repo, key, severity, confidence, ts); a null confidence counts as 0.75, a null repo or key as ''. Start it inside rocksdb()."""
    rows = findings.select(
        F.coalesce(F.col("repo").cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.col("severity").cast("string").alias("severity"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.75)).alias("confidence"), F.col("ts").cast("timestamp").alias("ts"),
    ).where("ts IS NOT NULL").withWatermark("ts", lateness).withColumn("at", F.unix_millis("ts"))
    return rows.groupBy("repo").transformWithStateInPandas(Timelines(samples, expire_days * DAY_MS), OUT, "Update", "EventTime")
