"""State kept over scans, in batch form: timelines, drift, recurring findings, caches, run statistics.

scans: (repo, key, title, category, severity, confidence, scan BIGINT): a row per finding and scan, the scans of each repository numbered in order of time.
"""

from __future__ import annotations

from ..functions import values as V
from ..functions.dialect import Dialect

SAMPLES = 20


def memory_key(d: Dialect) -> str:
    """Category and title; line and function references, signs and repeated blanks left out."""
    t = d.replace("lower(title)", r"\s+at\s+l?\d+", "")
    t = d.replace(t, r"\s+in\s+[a-z_]+\s*\(", "")
    t = d.replace(d.replace(t, "[^a-z0-9 ]", ""), r"\s+", "-")
    return f"concat(category, '::', trim({t}))"


def timeline_key(d: Dialect) -> str:
    return f"concat({d.replace('lower(title)', chr(92) + 's+', '-')}, ':', category)"


def drift(d: Dialect, scans: str, samples: int = SAMPLES) -> str:
    """Trend of a finding's confidence over its last samples: slope by order, spread, and a label."""
    n = d.num
    last = f"(SELECT key, COALESCE(confidence, {n(0.75)}) AS c, ROW_NUMBER() OVER (PARTITION BY key ORDER BY scan DESC, pos DESC) AS back FROM {scans} s)"
    kept = f"(SELECT key, c, CAST(-back AS DOUBLE) AS x FROM {last} l WHERE back <= {samples})"
    stats = f"(SELECT key, CAST(COUNT(*) AS BIGINT) AS n, CASE WHEN COUNT(*) < 2 THEN {n(0.0)} ELSE regr_slope(c, x) END AS slope, stddev_pop(c) AS spread FROM {kept} k GROUP BY key)"
    # compared in whole millionths, where the last bit of a sum does not decide
    milli = lambda x: d.half_up(f"{x} * {d.num(1e6)}")
    told = f"(SELECT key, n, {milli('slope')} AS slope_millionths, {milli('spread')} AS spread_millionths FROM {stats} s)"
    label = "CASE WHEN spread_millionths > 200000 THEN 'volatile' WHEN slope_millionths > 100000 THEN 'escalating' WHEN slope_millionths < -100000 THEN 'resolving' ELSE 'stable' END"
    return f"SELECT key, n, slope_millionths, spread_millionths, {label} AS label FROM {told} t"


def timelines(d: Dialect, scans: str) -> str:
    """First and last scan of each finding of a repository, how often it was seen, and whether it is in the repository's last scan. The first severity stays."""
    first = "struct(scan, pos)" if d.name == "spark" else "row(scan, pos)"
    told = f"(SELECT repo, key, min_by(severity, {first}) AS severity, MIN(scan) AS first_seen, MAX(scan) AS last_seen, CAST(COUNT(*) AS BIGINT) AS seen_count FROM {scans} s GROUP BY repo, key)"
    newest = f"(SELECT repo, MAX(last_seen) AS newest FROM {told} n GROUP BY repo)"
    return f"""SELECT t.repo, t.key, severity, first_seen, last_seen, seen_count, CASE WHEN last_seen = newest THEN 'active' ELSE 'resolved' END AS status,
      CASE WHEN last_seen < newest THEN last_seen + 1 END AS resolved_at FROM {told} t JOIN {newest} r ON t.repo = r.repo"""


def remember(d: Dialect, memory: str, scan: str) -> str:
    """A scan's findings put into a repository's memory.

    memory: (repo, key, seen_count, absent_scans, confirmed_fp, suppressed); scan: (repo, key, severity, n): findings of the scan by key, n of each.
    What is absent from the scan counts its absences: hence a full outer join per repository that was scanned.
    """
    joined = f"""(SELECT COALESCE(m.repo, s.repo) AS repo, COALESCE(m.key, s.key) AS key, s.severity, s.key IS NOT NULL AS here, COALESCE(m.seen_count, 0) + COALESCE(s.n, 0) AS seen, COALESCE(m.absent_scans, 0) AS absent,
      COALESCE(m.confirmed_fp, FALSE) AS fp, COALESCE(m.suppressed, FALSE) AS suppressed FROM {memory} m FULL OUTER JOIN {scan} s ON m.repo = s.repo AND m.key = s.key)"""
    limit = "CASE WHEN severity = 'high' THEN 6 ELSE 3 END"
    hush = f"(here AND fp AND seen >= {limit})"
    absent = "CASE WHEN here THEN 0 WHEN suppressed THEN absent ELSE absent + 1 END"
    status = f"CASE WHEN {hush} THEN 'suppressed' WHEN here AND seen = 1 THEN 'new' WHEN here THEN 'recurring' WHEN {absent} >= 3 THEN 'resolved' ELSE 'absent' END"
    return f"""SELECT j.repo, key, CAST(seen AS BIGINT) AS seen_count, CAST({absent} AS BIGINT) AS absent_scans, fp AS confirmed_fp, suppressed OR {hush} AS suppressed, {status} AS status, here AND NOT {hush} AND severity = 'high' AND seen >= 3 AS escalated
      FROM {joined} j JOIN (SELECT DISTINCT repo FROM {scan} z) r ON j.repo = r.repo"""


def memory_stats(d: Dialect, memory: str) -> str:
    n = lambda c: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    return f"SELECT CAST(COUNT(DISTINCT repo) AS BIGINT) AS repos, CAST(COUNT(*) AS BIGINT) AS findings, {n('confirmed_fp')} AS false_positives, {n('suppressed')} AS suppressed FROM {memory} m"


def usage(d: Dialect, calls: str) -> str:
    """Tokens and price by stage and model and over all. calls: (stage, model, prompt_chars, reply_chars); a token is four characters."""
    tok = lambda x: f"CAST(CEIL({x} / {d.num(4.0)}) AS BIGINT)"
    rate = lambda i: d.lookup("model", {m: p[i] for m, p in V.MODEL_PRICES.items()}, V.MODEL_PRICES["default"][i])
    # in billionths of a dollar, whole per call, so that sums do not depend on their order
    rows = f"(SELECT stage, model, {tok('prompt_chars')} AS t_in, {tok('reply_chars')} AS t_out, {rate(0)} AS r_in, {rate(1)} AS r_out FROM {calls} c)"
    cost = d.half_up(f"(t_in / {d.num(1000.0)} * r_in + t_out / {d.num(1000.0)} * r_out) * {d.num(1e9)}")
    return f"SELECT COALESCE(stage, 'all') AS stage, COALESCE(model, 'all') AS model, CAST(COUNT(*) AS BIGINT) AS calls, CAST(SUM(t_in) AS BIGINT) AS tokens_in, CAST(SUM(t_out) AS BIGINT) AS tokens_out, CAST(SUM({cost}) AS BIGINT) AS nano_usd FROM {rows} r GROUP BY ROLLUP(stage, model)"


def stage_report(d: Dialect, timings: str) -> str:
    """Per run: total time, slowest and fastest stage, cache hits. timings: (run_id, stage, start_ms, end_ms, cached)."""
    rows = f"(SELECT *, end_ms - start_ms AS ms, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY end_ms - start_ms DESC, start_ms, stage) AS slow, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY end_ms - start_ms, start_ms DESC, stage DESC) AS fast FROM {timings} t)"
    hits = "COUNT(CASE WHEN cached THEN 1 END)"
    return f"SELECT run_id, CAST(SUM(ms) AS BIGINT) AS total_ms, MAX(CASE WHEN slow = 1 THEN stage END) AS slowest, MAX(CASE WHEN fast = 1 THEN stage END) AS fastest, CAST(COUNT(*) AS BIGINT) AS stages, CAST({hits} AS BIGINT) AS cache_hits, CAST({hits} AS DOUBLE) / COUNT(*) AS hit_rate FROM {rows} r GROUP BY run_id"


def running_stats(d: Dialect, reports: str, block: int = 4096) -> str:
    """Totals after each run, in order. reports: (run_id, total_ms).

    Runs are summed in blocks of ids; only the blocks' sums meet in one place, and each block is gone through on its own.
    """
    rows = f"(SELECT run_id, total_ms, CAST(FLOOR(run_id / {d.num(float(block))}) AS BIGINT) AS blk FROM {reports} r)"
    sums = f"(SELECT blk, COUNT(*) AS n, SUM(total_ms) AS ms FROM {rows} a GROUP BY blk)"
    w = "OVER (ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = f"(SELECT blk, COALESCE(SUM(n) {w}, 0) AS n0, COALESCE(SUM(ms) {w}, 0) AS ms0 FROM {sums} b)"
    u = "OVER (PARTITION BY x.blk ORDER BY x.run_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    inner = f"(SELECT x.run_id, CAST(y.n0 + COUNT(*) {u} AS BIGINT) AS scans, CAST(y.ms0 + SUM(x.total_ms) {u} AS BIGINT) AS total_ms FROM {rows} x JOIN {before} y ON x.blk = y.blk)"
    return f"SELECT run_id, scans, total_ms, CAST(total_ms AS DOUBLE) / scans AS avg_ms FROM {inner} z"


def cache_state(d: Dialect, events: str, ttl: int = 1800, size: int = 200, now: str | None = None) -> str:
    """Entries of a stage cache at a time: not older than ttl seconds, the newest `size` of each stage. events: (stage, key, sec)."""
    time = now or f"(SELECT MAX(sec) FROM {events} n)"
    last = f"(SELECT stage, key, MAX(sec) AS sec FROM {events} e GROUP BY stage, key)"
    ranked = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY stage ORDER BY sec DESC, key) AS place FROM {last} l WHERE sec >= {time} - {ttl})"
    return f"SELECT stage, key, sec FROM {ranked} r WHERE place <= {size}"


def cache_hits(d: Dialect, events: str, ttl: int = 1800) -> str:
    """Hits and misses by stage and over all: a get is a hit if the same key was asked for within ttl before."""
    rows = f"(SELECT stage, sec - LAG(sec) OVER (PARTITION BY stage, key ORDER BY sec, id) AS since FROM {events} e)"
    hits = f"COUNT(CASE WHEN since <= {ttl} THEN 1 END)"
    return f"SELECT COALESCE(stage, 'all') AS stage, CAST(COUNT(*) AS BIGINT) AS gets, CAST({hits} AS BIGINT) AS hits, CAST({hits} AS DOUBLE) / COUNT(*) AS hit_rate FROM {rows} r GROUP BY ROLLUP(stage)"


def rate_limit(d: Dialect, requests: str, limit: int = 60, window: int = 60) -> str:
    """Requests per key and window of seconds, and how many were over the limit. requests: (key, sec)."""
    start = f"CAST(FLOOR(sec / {d.num(float(window))}) AS BIGINT) * {window}"
    return f"SELECT key, {start} AS window_start, CAST(COUNT(*) AS BIGINT) AS n, CAST(GREATEST(0, COUNT(*) - {limit}) AS BIGINT) AS refused FROM {requests} r GROUP BY key, {start}"
