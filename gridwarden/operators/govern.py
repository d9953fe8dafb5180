"""What people and models decide about findings, and the keys and logs that are kept of it: approvals, verdicts, caps, audits, cache keys."""

from __future__ import annotations

from ..functions import values as V
from ..functions.dialect import Dialect


def capped(d: Dialect, issues: str) -> str:
    """Confidence in hundredths, held under the most that a finding of its type may claim. An unknown type is held like a suggestion; null stays null."""
    cap = f"CASE WHEN type = 'bug' AND category = 'security' THEN {V.CONFIDENCE_CAPS['security bug']} ELSE {d.lookup('type', {k: v for k, v in V.CONFIDENCE_CAPS.items() if ' ' not in k}, V.CONFIDENCE_CAPS['suggestion'])} END"
    return f"SELECT doc_id, seq, CASE WHEN confidence IS NOT NULL THEN CAST(LEAST({cap}, GREATEST(0, {d.half_up(f'confidence * {d.num(100.0)}')})) AS INT) END AS confidence_pct FROM {issues} i"


def backed(d: Dialect, verdicts: str) -> str:
    """Verdict of the code where it has one, else that of the model, with less confidence. verdicts: (doc_id, seq, by_code 'flag', 'suppress' or 'neutral', by_model, confidence)."""
    own = "COALESCE(by_code, 'neutral') <> 'neutral'"
    return f"""SELECT doc_id, seq, CASE WHEN {own} THEN by_code ELSE by_model END AS verdict, CASE WHEN {own} THEN {d.num(1.0)} ELSE LEAST(confidence, {d.num(0.7)}) END AS confidence,
      CASE WHEN {own} THEN 'deterministic' ELSE 'ai' END AS source FROM {verdicts} v"""


def approved(d: Dialect, issues: str, approvals: str, now: str) -> str:
    """Findings that a repository has let pass, with the first reason: its approvals in force by title, then its trusted patterns by explanation.

    issues: (repo, doc_id, seq, title, explanation); approvals: (repo, pos, kind 'title' or 'trust', pattern, reason, expires_at in seconds or null). Patterns are
    regular expressions without regard to case; in those of titles a star stands for any text. One that is no pattern matches nothing: refused() names these.
    """
    live = f"(SELECT * FROM {_patterns(d, approvals)} a WHERE kind = 'trust' OR expires_at IS NULL OR expires_at >= {now})"
    text = "CASE a.kind WHEN 'title' THEN i.title ELSE i.explanation END"
    met = f"(SELECT i.doc_id, i.seq, a.kind, a.reason, ROW_NUMBER() OVER (PARTITION BY i.doc_id, i.seq ORDER BY CASE a.kind WHEN 'title' THEN 0 ELSE 1 END, a.pos) AS place FROM {issues} i JOIN {live} a ON i.repo = a.repo AND {d.matches(text, 'a.rx')})"
    return f"SELECT doc_id, seq, kind, reason FROM {met} m WHERE place = 1"


def _patterns(d: Dialect, approvals: str) -> str:
    """Approvals with their pattern made ready, null where it is none."""
    rx = "concat('(?i)', CASE kind WHEN 'title' THEN replace(pattern, '*', '.*') ELSE pattern END)"
    return f"(SELECT *, CASE WHEN {d.compiles(rx)} THEN {rx} END AS rx FROM {approvals} ap)"


def refused(d: Dialect, approvals: str) -> str:
    """Approvals whose pattern is none, so that they let nothing pass."""
    return f"SELECT repo, pos, kind, pattern, 'no valid pattern' AS why FROM {_patterns(d, approvals)} a WHERE rx IS NULL"


def audit_log(d: Dialect, entries: str, limit: int = 100) -> str:
    """The newest entries. entries: (happened, id, action)."""
    return f"SELECT id, action, happened FROM {entries} e ORDER BY happened DESC, id DESC LIMIT {limit}"


def latest_run(d: Dialect, runs: str) -> str:
    """The run that began last. runs: (run_id, happened)."""
    return f"SELECT run_id, happened FROM {runs} r ORDER BY happened DESC, run_id DESC LIMIT 1"


def content_keys(d: Dialect, files: str, variant: str = "''") -> str:
    """Key of a file's results in a cache: version of the results, hash of the text, variant of the settings."""
    return f"SELECT doc_id, concat({d.text(V.CACHE_VERSION)}, ':', {d.sha256('code')}, ':', {variant}) AS cache_key FROM {files} f"


def fingerprints(d: Dialect, files: str) -> str:
    """Fingerprint of a source tree without a name: a 32-bit FNV hash, in double arithmetic, of its first ten imports."""
    found = d.extract_all("code", V.IMPORT_MARK)
    return f"SELECT doc_id, {d.fnv(d.first_joined(found, 10, '|'))} AS fingerprint FROM {files} f"


def stage_results(d: Dialect, stages: dict[str, str]) -> str:
    """Findings that go into each stage and that come out, along one run: what one stage keeps is what the next one gets. stages: by name and in order, (doc_id, seq, kept) of each finding."""
    names = list(stages)
    joined = f"{stages[names[0]]} s0" + "".join(f" JOIN {stages[k]} s{i} ON s0.doc_id = s{i}.doc_id AND s0.seq = s{i}.seq" for i, k in enumerate(names) if i)
    return stage_counts(d, names, f"(SELECT s0.doc_id, {', '.join(f's{i}.kept AS k{i}' for i in range(len(names)))} FROM {joined})")


def stage_counts(d: Dialect, names: list[str], flags: str) -> str:
    """stage_results() of (doc_id, k0, k1, ...): whether each stage keeps a finding."""
    here = [" AND ".join(["TRUE", *(f"k{j}" for j in range(i))]) for i in range(len(names) + 1)]
    n = lambda c, name: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT) AS {name}"
    counts = f"(SELECT doc_id, {', '.join(n(c, f'n{i}') for i, c in enumerate(here))} FROM {flags} f GROUP BY doc_id)"
    # one row a document, put apart by stage: findings are looked at once
    each = d.explode(f"(SELECT *, {d.array([d.text(k) for k in names])} AS names FROM {counts} c) s", "names", "stage", "pos")
    pick = lambda off: "CASE pos " + " ".join(f"WHEN {i + 1} THEN n{i + off}" for i in range(len(names))) + " END"
    return f"SELECT doc_id, stage, {pick(0)} AS issues_in, {pick(1)} AS issues_out, {pick(1)} - {pick(0)} AS delta FROM {each} e"


def task_stats(d: Dialect, assigned: str) -> str:
    """Tasks by kind and in all, and the share of cost that they save against the dearest model. assigned: (task, cost_hundredths)."""
    cost = f"CAST(SUM(cost_hundredths) AS DOUBLE) / {d.num(100.0)}"
    return f"SELECT COALESCE(task, 'all') AS task, CAST(COUNT(*) AS BIGINT) AS n, {d.num(1.0)} - {cost} / COUNT(*) AS saved FROM {assigned} a GROUP BY ROLLUP(task)"
