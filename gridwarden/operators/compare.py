"""Scans compared: with an earlier one, with what was expected, and between reviewers."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .score import deduction


def fingerprint(d: Dialect) -> str:
    return f"concat(type, ':', severity, ':', {d.left('lower(title)', 40)})"


def delta(d: Dialect, current: str, baseline: str) -> str:
    """Findings that are new or gone since the baseline, by type, severity and start of title; a new one whose title is among the gone is a regression."""
    named = lambda x: f"(SELECT doc_id, seq, title, {fingerprint(d)} AS k FROM {x} i)"
    anti = lambda a, b: f"(SELECT a.* FROM {named(a)} a LEFT JOIN (SELECT DISTINCT doc_id, k FROM {named(b)} z) b ON a.doc_id = b.doc_id AND a.k = b.k WHERE b.k IS NULL)"
    short = d.left("lower(title)", 30)
    gone = f"(SELECT DISTINCT doc_id, {short} AS t FROM {anti(baseline, current)} g)"
    return f"""SELECT n.doc_id, n.seq, n.title, CASE WHEN g.t IS NULL THEN 'new' ELSE 'regression' END AS status FROM (SELECT *, {short} AS t FROM {anti(current, baseline)} x) n LEFT JOIN {gone} g ON n.doc_id = g.doc_id AND n.t = g.t
      UNION ALL SELECT doc_id, seq, title, 'resolved' AS status FROM {anti(baseline, current)} r"""


def delta_stats(d: Dialect, current: str, baseline: str) -> str:
    n = lambda s: f"CAST(COUNT(CASE WHEN status IN {s} THEN 1 END) AS BIGINT)"
    new, gone = n("('new', 'regression')"), n("('resolved')")
    return f"SELECT doc_id, {new} AS new_issues, {n("('regression')")} AS regressions, {gone} AS resolved, {new} - {gone} AS net FROM ({delta(d, current, baseline)}) x GROUP BY doc_id"


def outcomes(d: Dialect, vectors: str, found: str, severity_match: bool = True) -> str:
    """TP, FP, TN or FN of each labelled file: flagged if a finding in it names its class, or, for parity, has its severity."""
    named = f"({d.find('lower(i.category)', 'v.vuln_class')} > 0 OR {d.find('lower(i.title)', 'v.vuln_class')} > 0" + (" OR i.severity = v.vector_severity)" if severity_match else ")")
    flagged = f"(SELECT v.doc_id, MIN(v.vector_id) AS vector_id, MIN(v.vuln_class) AS vuln_class, MAX(CASE WHEN v.should_flag THEN 1 ELSE 0 END) AS want, MAX(CASE WHEN i.doc_id IS NOT NULL AND {named} THEN 1 ELSE 0 END) AS got FROM {vectors} v LEFT JOIN {found} i ON v.doc_id = i.doc_id GROUP BY v.doc_id)"
    return f"SELECT doc_id, vector_id, vuln_class, CASE WHEN want = 1 AND got = 1 THEN 'TP' WHEN want = 1 THEN 'FN' WHEN got = 1 THEN 'FP' ELSE 'TN' END AS outcome FROM {flagged} f"


def confusion(d: Dialect, results: str) -> str:
    """Counts and rates by class and over all, in one rollup. Rates of nothing: precision and recall 1, F1 and false-positive rate 0."""
    n = {k: f"CAST(COUNT(CASE WHEN outcome = '{k.upper()}' THEN 1 END) AS BIGINT)" for k in ("tp", "fp", "tn", "fn")}
    counts = f"(SELECT COALESCE(vuln_class, 'all') AS vuln_class, {', '.join(f'{v} AS {k}' for k, v in n.items())} FROM {results} r GROUP BY ROLLUP(vuln_class))"
    ratio = lambda a, b, other: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE {d.num(other)} END"
    rates = f"(SELECT *, {ratio('tp', 'tp + fp', 1.0)} AS p, {ratio('tp', 'tp + fn', 1.0)} AS r, {ratio('tp + tn', 'tp + fp + tn + fn', 1.0)} AS a, {ratio('fp', 'fp + tn', 0.0)} AS f FROM {counts} c)"
    return f"SELECT vuln_class, tp, fp, tn, fn, p AS precision_, r AS recall_, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE {d.num(0.0)} END AS f1, a AS accuracy, f AS fp_rate FROM {rates} x"


def regressions(d: Dialect, current: str, baseline: str) -> str:
    worse = "(b.outcome = 'TP' AND c.outcome = 'FN') OR (b.outcome = 'TN' AND c.outcome = 'FP')"
    better = "(b.outcome = 'FN' AND c.outcome = 'TP') OR (b.outcome = 'FP' AND c.outcome = 'TN')"
    return f"SELECT c.doc_id, c.vector_id, b.outcome AS was, c.outcome AS now, CASE WHEN {worse} THEN 'regression' ELSE 'improvement' END AS change FROM {current} c JOIN {baseline} b ON c.doc_id = b.doc_id WHERE ({worse}) OR ({better})"


def arbitrate(d: Dialect, issues: str, votes: str, place: str = "") -> str:
    """Verdict of four roles and a judge on each finding, joined by title; the last answer of a role counts, of several at one pos the first by place, a column of votes.

    Two against and none for rejects. Otherwise the judge's score, or one from the votes; split or weak verdicts go to a person.
    """
    last = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, title, role ORDER BY pos DESC{place and f', {place}'}) AS place FROM {votes} v)"
    of = lambda role, x, name: f"MAX(CASE WHEN role = '{role}' THEN {x} END) AS {name}"
    b = lambda x: f"CASE WHEN {x} THEN 1 ELSE 0 END"
    by_title = f"""(SELECT doc_id, title, {of('analyzer', "'confirmed'", 'analyzer')}, {of('critic', 'vote', 'critic')}, {of('verifier', b('exploit_verified'), 'verified')}, {of('fix', 'fix_vote', 'fix_vote')},
      MAX(judge_score) AS judge_score, MAX({b('judge_escalate AND judge_score IS NOT NULL')}) AS judge_escalate FROM {last} l WHERE place = 1 GROUP BY doc_id, title)"""
    joined = f"""(SELECT i.doc_id, i.seq, i.type, i.severity, i.fix, v.analyzer, v.critic, v.verified, COALESCE(v.fix_vote, 'none') AS fix_vote, v.judge_score, COALESCE(v.judge_escalate, 0) AS judge_escalate,
      {b("v.analyzer = 'confirmed'")} + {b("v.critic = 'confirmed'")} + {b('v.verified = 1')} AS pos, {b("v.analyzer = 'rejected'")} + {b("v.critic = 'rejected'")} + {b('v.verified = 0')} AS neg
      FROM {issues} i LEFT JOIN {by_title} v ON i.doc_id = v.doc_id AND i.title = v.title)"""
    scored = f"(SELECT *, COALESCE(judge_score, GREATEST(30, LEAST(95, pos * 30 - 15 * neg + 50))) AS consensus FROM {joined} j)"
    return f"""SELECT doc_id, seq, COALESCE(analyzer, 'uncertain') AS analyzer, COALESCE(critic, 'uncertain') AS critic, CASE verified WHEN 1 THEN 'confirmed' WHEN 0 THEN 'rejected' ELSE 'uncertain' END AS verifier, fix_vote,
      neg >= 2 AND pos = 0 AS rejected, CAST(consensus AS INT) AS consensus_score, (judge_escalate = 1 OR (pos = 1 AND neg = 1) OR consensus < 60) AS escalate, CASE WHEN fix_vote = 'bypassable' THEN NULL ELSE fix END AS fix, type, severity FROM {scored} s"""


def consensus_stats(d: Dialect, issues: str, votes: str, place: str = "") -> str:
    n = lambda c: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    return f"""SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total, {n('NOT rejected AND consensus_score >= 80')} AS agreed, {n('NOT rejected AND escalate')} AS escalated, {n('rejected')} AS rejected,
      CAST(GREATEST(0, 100 - SUM(CASE WHEN rejected THEN 0 ELSE {deduction(d)} END)) AS BIGINT) AS score FROM ({arbitrate(d, issues, votes, place)}) a GROUP BY doc_id"""


def confirmations(d: Dialect, issues: str, votes: str) -> str:
    """Share of five reviewers that confirm a finding; from four on it is proven. Titles are compared without case and signs."""
    norm = lambda x: d.left(f"trim({d.replace(f'lower({x})', '[^a-z0-9]+', ' ')})", 60)
    per = f"(SELECT doc_id, {norm('title')} AS t, COUNT(DISTINCT CASE WHEN vote = 'confirmed' THEN role END) AS n, COUNT(DISTINCT CASE WHEN vote = 'rejected' THEN role END) AS against FROM {votes} v GROUP BY doc_id, {norm('title')})"
    share = d.half_up("CAST(100 * (1 + COALESCE(p.n, 0)) AS DOUBLE) / 5")
    return f"SELECT i.doc_id, i.seq, CAST(1 + COALESCE(p.n, 0) AS INT) AS confirmations, {share} AS consensus, 1 + COALESCE(p.n, 0) >= 4 AS proven FROM (SELECT *, {norm('title')} AS t FROM {issues} x) i LEFT JOIN {per} p ON i.doc_id = p.doc_id AND i.t = p.t WHERE COALESCE(p.against, 0) < 2"
