"""The whole scan of source files: rules, data flow, pages, requests and frameworks, put together, deduplicated, held to evidence and policy.

lines: flow.flagged(); tainted: flow.tainted().
"""

from __future__ import annotations

from ..functions.dialect import Dialect
from . import flow, rules, suppress


def findings(d: Dialect, files: str, lines: str, tainted: str) -> str:
    """Findings of every part, numbered by document; of equal lines and starts of titles the first part's stays."""
    sinks = f"({flow.score_flow(d, f'({flow.sink_findings(d, lines, tainted)})')})"
    none = "CAST(NULL AS VARCHAR(10))"
    row = lambda part, line, title, severity, confidence, chain: f"SELECT doc_id, {part} AS part, CAST({line} AS INT) AS line, {title} AS title, {severity} AS severity, {confidence} AS confidence, {chain} AS exploit_chain"
    pct = lambda x: f"CAST({x} AS DOUBLE) / {d.num(100.0)}"
    arrow = d.text(" -> ")
    severe = "CASE WHEN blast_radius IN ('critical', 'high') THEN 'high' ELSE 'medium' END"
    parts = [
        f"{row(1, 'line_no', f'concat(cwe, {d.text(chr(32))}, var, {d.text(chr(32))}, sink)', severe, pct('confidence'), f'concat({d.text('outside input -> ')}, var, {arrow}, {d.text('line ')}, CAST(line_no AS VARCHAR(12)), {arrow}, sink)')} FROM {sinks} s",
        f"{row(2, 'line_no', f'concat({d.text('xss in ')}, context)', d.text('high'), d.num(0.85), f'concat({d.text('outside input -> ')}, var, {arrow}, {d.text('written to the page as ')}, context)')} FROM ({flow.page_findings(d, lines, tainted)}) p",
        f"{row(3, 'line_no', f'concat({d.text('ssrf by ')}, kind)', d.text('high'), pct('confidence'), f'concat({d.text('outside input -> ')}, var, {arrow}, {d.text('address of a request')})')} FROM ({flow.request_findings(d, lines, tainted)}) q",
        f"{row(4, 'line_no', 'kind', 'severity', d.num(0.8), none)} FROM ({flow.framework_findings(d, lines, files)}) w",
        f"{row(5, 'line_no', 'rule_id', 'severity', d.num(0.75), none)} FROM ({rules.collapsed(d, files)}) r",
    ]
    key = d.left("title", 40)
    first = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, line, {key} ORDER BY part, title, exploit_chain, confidence) AS place FROM ({' UNION ALL '.join(parts)}) u)"
    return f"""SELECT doc_id, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY part, line, title) AS INT) AS seq, 'bug' AS type, severity, 'security' AS category, title, title AS explanation, line, confidence,
      CAST(NULL AS BOOLEAN) AS exploit_verified, exploit_chain, CAST(NULL AS VARCHAR(10)) AS exploit_payload, CAST(NULL AS BOOLEAN) AS sink_reachable FROM {first} f WHERE place = 1"""


def verdicts(d: Dialect, found: str, packs: list[str] | None = None) -> str:
    """Of each document with findings: how many, how many severe ones have the evidence that they need, and whether it may be merged. found: findings(), as a table, since the plan has it several times."""
    held = f"(SELECT f.doc_id, f.seq, e.type, e.severity, f.category, f.title, f.explanation, f.line, f.confidence, f.exploit_verified FROM {found} f JOIN ({suppress.mandatory_evidence(d, found)}) e ON f.doc_id = e.doc_id AND f.seq = e.seq)"
    n = f"(SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS findings, CAST(COUNT(CASE WHEN severity = 'high' THEN 1 END) AS BIGINT) AS proven FROM {held} h GROUP BY doc_id)"
    return f"SELECT g.doc_id, n.findings, n.proven, g.policy_pass, g.gate_pass, g.n_blocked, g.n_severe, g.reasons FROM ({suppress.gate(d, held, packs)}) g JOIN {n} n ON g.doc_id = n.doc_id"
