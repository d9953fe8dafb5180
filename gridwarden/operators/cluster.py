"""Findings put together: first-wins keys, buckets of lines, root causes, families."""

from __future__ import annotations

from ..functions import values as V
from ..functions.dialect import Dialect
from . import classify as C
from . import score as S

RANK = "(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)"


def _line(other: str = "?") -> str:
    return f"COALESCE(CAST(line AS VARCHAR(12)), '{other}')"


def first_wins(d: Dialect, issues: str, key: str = "line_title") -> str:
    """The first finding of each key in a document: line and start of title, or line, severity and type."""
    keys = {"line_title": f"concat({_line()}, ':', {d.left('title', 35)})", "line_severity": f"concat({_line('-1')}, ':', severity)", "title": f"{d.left('lower(title)', 40)}"}
    return f"SELECT doc_id, seq, k, CAST(n AS BIGINT) AS n FROM (SELECT doc_id, seq, k, ROW_NUMBER() OVER (PARTITION BY doc_id, k ORDER BY seq) AS place, COUNT(*) OVER (PARTITION BY doc_id, k) AS n FROM (SELECT doc_id, seq, {keys[key]} AS k FROM {issues}) x) y WHERE place = 1"


def normal_title(d: Dialect, x: str = "title") -> str:
    """Lower case, one blank between, without joining words and the letter after them."""
    return d.strip(d.replace(d.replace(f"lower({x})", r"\s+", " "), r"\b(?:via|using|with|in|at|through)\b.", ""))


def semantic_dedup(d: Dialect, issues: str) -> str:
    """One finding per type, severity, title and three lines; the first stays and says how many it stands for."""
    bucket = f"COALESCE(CAST(FLOOR(line / {d.num(3.0)}) AS INT), -1)"
    keyed = f"(SELECT doc_id, seq, title, type, severity, {normal_title(d)} AS t, {bucket} AS b FROM {issues})"
    w = "PARTITION BY doc_id, type, severity, t, b"
    return f"SELECT doc_id, seq, title, CAST(n - 1 AS BIGINT) AS similar FROM (SELECT *, ROW_NUMBER() OVER ({w} ORDER BY seq) AS place, COUNT(*) OVER ({w}) AS n FROM {keyed} x) y WHERE place = 1"


def root_classes(d: Dialect) -> dict[str, str]:
    """What depends on a finding's texts alone."""
    return {"family": C.root_family(d), "sink": C.root_sink(d), "zone": C.root_zone(d)}


def root_causes(d: Dialect, issues: str, told: bool = False) -> str:
    """Findings of one class, sink and five lines are one cause, told by its most confident finding.

    The order within a document is by exploitability and confidence, suppressed ones last. told: the issues have their root_classes() already.
    """
    group = f"COALESCE(CAST(FLOOR(line / {d.num(5.0)}) AS INT), -1)"
    classes = {} if told else root_classes(d)
    named = f"(SELECT *, {''.join(f'{v} AS {k}, ' for k, v in classes.items())}{group} AS line_group FROM {S.with_root_confidence(d, issues)} i)"
    w = "PARTITION BY doc_id, family, sink, line_group"
    ranked = f"(SELECT *, ROW_NUMBER() OVER ({w} ORDER BY conf DESC, seq) AS place, CASE WHEN line IS NOT NULL AND ROW_NUMBER() OVER ({w}, line ORDER BY seq) = 1 THEN CAST(line AS VARCHAR(12)) END AS new_line FROM {named} n)"
    pick = lambda c: f"MAX(CASE WHEN place = 1 THEN {c} END) AS {c}"
    grouped = f"(SELECT doc_id, family, sink, line_group, {', '.join(pick(c) for c in ('zone', 'title', 'explanation', 'type', 'severity', 'conf'))}, CAST(COUNT(*) AS BIGINT) AS n, MIN(seq) AS first_seq, {d.collect('new_line', 'line')} AS affected_lines FROM {ranked} r GROUP BY doc_id, family, sink, line_group)"
    final = f"(SELECT *, CAST(CASE WHEN n = 1 THEN GREATEST(40, conf - 5) ELSE LEAST(98, conf + LEAST(5, (n - 1) * 2)) END AS BIGINT) AS confidence FROM {grouped} g)"
    quiet = " OR ".join(f"(family = '{f}' AND {d.match('text', p, 'i')} AND confidence <= {m})" for f, p, m in V.ROOT_SUPPRESSIONS)
    told = f"(SELECT *, {quiet} AS suppressed FROM (SELECT *, concat(title, ' ', explanation) AS text FROM {final} f) x)"
    full = f"(SELECT *, {d.lookup('family', V.FAMILY_EXPLOITABILITY, 50)} AS exploitability, {d.lookup('sink', V.SINK_REACHABILITY, 50)} AS reachability, {d.lookup('family', V.BLAST_RADIUS, 'low')} AS blast_radius FROM {told} t)"
    return f"""SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY CASE WHEN suppressed THEN 1 ELSE 0 END, exploitability * confidence DESC, first_seq) AS INT) AS place, family, sink, zone, title, type, severity,
      confidence, exploitability, reachability, blast_radius, n - 1 AS variants, affected_lines, suppressed FROM {full} z"""


def root_score(d: Dialect, issues: str) -> str:
    """Score of a document from its causes: deduction by confidence and blast radius, and a little for variants."""
    n = d.num
    factor = d.lookup("blast_radius", V.BLAST_FACTOR, 0.7)
    one = f"({S.deduction(d)} * (confidence / {n(100.0)}) * {factor}) + LEAST({n(5.0)}, variants * {n(1.5)})"
    # in units of a millionth, so that sums do not depend on their order
    total = f"SUM(CASE WHEN suppressed THEN 0 ELSE {d.half_up(f'({one}) * {n(1e6)}')} END)"
    live = lambda c: f"CAST(COUNT(CASE WHEN NOT suppressed AND {c} THEN 1 END) AS BIGINT)"
    return f"""SELECT doc_id, GREATEST(0, {d.half_up(f'{n(100.0)} - CAST({total} AS DOUBLE) / {n(1e6)}')}) AS score, {live('TRUE')} AS surfaces, {live("blast_radius = 'critical'")} AS critical, {live("blast_radius = 'high'")} AS high,
      CAST(SUM(variants) AS BIGINT) AS collapsed, CAST(COUNT(CASE WHEN suppressed THEN 1 END) AS BIGINT) AS n_suppressed FROM ({root_causes(d, issues)}) g GROUP BY doc_id"""


def family_classes(d: Dialect) -> dict[str, str]:
    """What depends on a finding's texts and line alone."""
    return {"family": C.cluster_family(d), "sink": C.cluster_sink(d)}


def families(d: Dialect, issues: str, told: bool = False) -> str:
    """Findings of a class in a document: the most severe severity, the first most confident finding, sinks and lines in order of appearance. told: the issues have their family_classes() already."""
    named = f"(SELECT * FROM {issues})" if told else f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in family_classes(d).items())} FROM {issues})"
    w = "PARTITION BY doc_id, family"
    ranked = f"""(SELECT *, ROW_NUMBER() OVER ({w} ORDER BY COALESCE(confidence, 0) DESC, seq) AS place, CASE WHEN ROW_NUMBER() OVER ({w}, sink ORDER BY seq) = 1 THEN sink END AS new_sink,
      CASE WHEN line IS NOT NULL AND ROW_NUMBER() OVER ({w}, line ORDER BY seq) = 1 THEN CAST(line AS VARCHAR(12)) END AS new_line FROM {named} x)"""
    grouped = f"""(SELECT doc_id, family, MAX({RANK}) AS sev, MAX(CASE WHEN place = 1 THEN title END) AS title, MAX(COALESCE(confidence, 0)) AS confidence, CAST(COUNT(*) AS BIGINT) AS total,
      CAST(COUNT(CASE WHEN exploit_verified THEN 1 END) AS BIGINT) AS verified, {d.collect('new_sink', 'seq')} AS sinks, {d.collect('new_line', 'seq')} AS lines, MIN(seq) AS first_seq FROM {ranked} r GROUP BY doc_id, family)"""
    label = d.lookup("family", {f: name for _, f, name in V.CLUSTER_FAMILIES} | {"other": "Other"}, "Other")
    return f"""SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY sev DESC, total DESC, first_seq) AS INT) AS place, family, {label} AS label, CASE sev WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
      title, confidence, total, verified, sinks, lines FROM {grouped} g"""


def family_stats(d: Dialect, issues: str) -> str:
    top = "CASE WHEN place <= 5 THEN label END"
    return f"SELECT doc_id, CAST(SUM(total) AS BIGINT) AS input_count, CAST(COUNT(*) AS BIGINT) AS family_count, CAST(SUM(total) - COUNT(*) AS BIGINT) AS collapsed, {d.collect(top, 'place', '; ')} AS top_families FROM ({families(d, issues)}) f GROUP BY doc_id"
