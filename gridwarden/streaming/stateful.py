"""Streams with state of their own: a rate limit whose window starts with the first request, and timelines of findings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW_S, LIMIT, UNKNOWN_LIMIT = 60, 60, 120


def limit_requests(requests: DataFrame, key_col: str = "key", time_col: str = "ts", window_s: int = WINDOW_S, limit: int = LIMIT, unknown_limit: int = UNKNOWN_LIMIT, lateness: str = "10 minutes") -> DataFrame:
    """(key, n, allowed, refused) for each key and batch. A window starts at the first request after the last one ended, not at a round time.

    State per key is two numbers, dropped when no request can fall into the window any more.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, ends = state.get if state.exists else (0, -1)
        most = unknown_limit if key[0] == "unknown" else limit
        times = sorted(t for b in batches for t in (b["at"].astype("int64")).tolist())
        allowed = 0
        for t in times:
            if t > ends:
                count, ends = 1, t + window_s
                allowed += 1
            elif count < most:
                count += 1
                allowed += 1
        state.update((count, ends))
        state.setTimeoutTimestamp(max((ends + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "n": [len(times)], "allowed": [allowed], "refused": [len(times) - allowed]})

    rows = requests.select(F.coalesce(F.col(key_col).cast("string"), F.lit("unknown")).alias("key"), F.col(time_col).cast("timestamp").alias("ts")).withWatermark("ts", lateness).withColumn("at", F.unix_timestamp("ts"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, n long, allowed long, refused long", "count long, ends long", "append", GroupStateTimeout.EventTimeTimeout)


def track_findings(findings: DataFrame, key_col: str = "key", time_col: str = "ts", confidence_col: str = "confidence", samples: int = 20) -> DataFrame:
    """(key, seen, first_seen, last_seen, slope, label) after each batch: how a finding's confidence moves over its last samples. Times in seconds."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, first, last, kept = state.get if state.exists else (0, None, None, [])
        rows = sorted((int(t), float(c)) for b in batches for t, c in zip(b["at"], b["confidence"], strict=True))
        kept = [*kept, *(c for _, c in rows)][-samples:]
        seen += len(rows)
        first = min([x for x in (first, *(t for t, _ in rows)) if x is not None])
        last = max([x for x in (last, *(t for t, _ in rows)) if x is not None])
        state.update((seen, first, last, kept))
        slope, label = drift(kept)
        yield pd.DataFrame({"key": [key[0]], "seen": [seen], "first_seen": [first], "last_seen": [last], "slope": [slope], "label": [label]})

    rows = findings.select(F.col(key_col).cast("string").alias("key"), F.unix_timestamp(F.col(time_col).cast("timestamp")).alias("at"), F.coalesce(F.col(confidence_col).cast("double"), F.lit(0.75)).alias("confidence"))
    state = "seen long, first long, last long, kept array<double>"
    return rows.groupBy("key").applyInPandasWithState(step, "key string, seen long, first_seen long, last_seen long, slope double, label string", state, "update", GroupStateTimeout.NoTimeout)


def drift(values: list[float]) -> tuple[float, str]:
    """Slope by order, and the label that it and the spread give."""
    n = len(values)
    if n < 2:
        return 0.0, "stable"
    mx, my = (n - 1) / 2, sum(values) / n
    slope = sum((i - mx) * (v - my) for i, v in enumerate(values)) / sum((i - mx) ** 2 for i in range(n))
    spread = (sum((v - my) ** 2 for v in values) / n) ** 0.5
    return slope, "volatile" if spread > 0.2 else "escalating" if slope > 0.1 else "resolving" if slope < -0.1 else "stable"


def to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is, each batch written once under its number, and returns the rows."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows").select(*stream.columns)
