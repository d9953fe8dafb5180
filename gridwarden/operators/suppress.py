"""What is done about findings that may be false: trust, firewall, minimizer, proof, dominance, policy, gate."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import values as V
from ..functions.dialect import Dialect
from . import classify as C
from .cluster import _line


def _by_class(d: Dialect, cls: str, x: str, table: dict[str, list], fallback: str | None = None) -> str:
    """True if a pattern of the finding's class is found; classes that the table lacks use another class, or none."""
    other = d.any(x, table[fallback]) if fallback else "FALSE"
    return f"(CASE {cls} " + " ".join(f"WHEN '{k}' THEN {d.any(x, p)}" for k, p in table.items()) + f" ELSE {other} END)"


def trust(d: Dialect, cases: str) -> str:
    """Findings that safe patterns of their file cover: suppressed from a trust of 0.9, toned down from 0.7."""
    n = d.num
    fams = {label for _, labels in V.TRUST_FAMILIES for label in labels}
    # the most trusted pattern of a class; of equals the first
    best = {}
    for f in sorted(fams):
        rows = sorted((r for r in V.TRUSTED if f in r[3]), key=lambda r: -r[4])
        best[f] = [(d.match("code", r[1], r[2]), r[0], r[4]) for r in rows]
    case = lambda rows, k: "CASE " + " ".join(f"WHEN {c} THEN {d.text(r[k]) if k == 0 else n(r[k])}" for c, *r in rows) + " END"
    text = "lower(concat(title, ' ', explanation))"
    order = [(d.match(text, p), label) for p, labels in V.TRUST_FAMILIES for label in labels]
    # of the finding's classes in order, the first that a pattern covers
    pattern = "COALESCE(" + ", ".join(f"CASE WHEN {c} THEN {case(best[f], 0)} END" for c, f in order if best[f]) + ")"
    gone = [(d.match("code", p), kills) for _, p, kills in V.TRUST_FRAMEWORKS if kills]
    framework = " OR ".join(f"({c} AND {d.match(text, fp)})" for c, kills in gone for fp, labels in V.TRUST_FAMILIES if set(kills) & set(labels))
    value = d.lookup("pattern_id", {r[0]: r[4] for r in V.TRUSTED}, None)
    rows = f"(SELECT *, {value} AS trust FROM (SELECT doc_id, seq, severity, confidence, ({framework}) AS by_framework, {pattern} AS pattern_id FROM {cases} c) x)"
    action = f"CASE WHEN by_framework THEN 'framework' WHEN trust >= {n(0.9)} THEN 'suppress' WHEN trust >= {n(0.7)} THEN 'tone down' ELSE 'keep' END"
    return f"""SELECT doc_id, seq, action, CASE WHEN action IN ('suppress', 'tone down') THEN pattern_id END AS pattern_id, CASE WHEN action = 'tone down' AND severity = 'high' THEN 'medium' ELSE severity END AS severity,
      CASE WHEN action = 'tone down' THEN LEAST(COALESCE(confidence, {n(0.75)}), {n(0.65)}) ELSE confidence END AS confidence FROM (SELECT *, {action} AS action FROM {rows} r) t"""


def trust_score(d: Dialect, cases: str, files: str) -> str:
    """How far a file is trusted: 50, and more for safe patterns, safe frameworks and findings that they cover."""
    n = d.num
    per = f"(SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(CASE WHEN action IN ('framework', 'suppress') THEN 1 END) AS BIGINT) AS n_suppressed FROM ({trust(d, cases)}) t GROUP BY doc_id)"
    pats = d.count_of(d.match("code", r[1], r[2]) for r in V.TRUSTED)
    frames = d.count_of(d.match("code", r[1]) for r in V.TRUST_FRAMEWORKS)
    score = f"LEAST({n(100.0)}, 50 + LEAST(30, patterns * 5) + LEAST(20, frameworks * 8) + CASE WHEN COALESCE(total, 0) = 0 THEN {n(0.0)} ELSE (CAST(n_suppressed AS DOUBLE) / total) * 30 END)"
    return f"SELECT f.doc_id, f.patterns, f.frameworks, COALESCE(total, 0) AS total, COALESCE(n_suppressed, 0) AS n_suppressed, {d.half_up(score)} AS trust_score FROM (SELECT doc_id, {pats} AS patterns, {frames} AS frameworks FROM {files} x) f LEFT JOIN {per} p ON f.doc_id = p.doc_id"


def _firewall_looks(d: Dialect, cases: str) -> tuple[str, str, str]:
    """Cases with family and what is at their line, and two values of them by patterns: whether the claim's line and its source are there."""
    ls = d.lines("code")
    fam = f"(SELECT *, {C.firewall_family(d)} AS family, {d.size(ls)} AS n_lines, {d.strip(d.window('code', 'line', 'line'))} AS target, {d.window('code', 'line - 3', 'line + 3')} AS near FROM {cases} c)"
    at_line = f"""CASE WHEN line IS NULL THEN TRUE WHEN line < 1 OR line > n_lines THEN FALSE WHEN target = '' OR {d.left('target', 2)} = '//' OR {d.left('target', 1)} = '*' THEN FALSE
      WHEN family IS NULL THEN TRUE ELSE {_by_class(d, 'family', 'near', V.FIREWALL_SINKS)} END"""
    return fam, at_line, f"(type <> 'bug' OR category <> 'security' OR {d.any('code', V.FIREWALL_SOURCES)})"


def firewall_told(d: Dialect, cases: str) -> str:
    """Of cases with a digest what depends on their texts, type, category, line and code alone."""
    fam, at_line, source = _firewall_looks(d, cases)
    return f"SELECT digest, family, {at_line} AS told_line, {source} AS told_source FROM {fam} f"


def _firewall_scored(d: Dialect, cases: str, told: bool) -> tuple[str, str]:
    """Cases with conf and violations, and when one is dropped. told: the cases have the columns of firewall_told() already."""
    n = d.num
    fam, at_line, source = (cases, "told_line", "told_source") if told else _firewall_looks(d, cases)
    schema = d.count_of(["length(title) < 5", "length(explanation) < 20", "type NOT IN ('bug', 'risk', 'suggestion')", "severity NOT IN ('high', 'medium', 'low')", "COALESCE(confidence < 0 OR confidence > 1, FALSE)"])
    floor = d.lookup("family", V.SEVERITY_FLOOR, None)
    rank = lambda x: f"(CASE {x} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 END)"
    over = "(type = 'suggestion' AND severity <> 'low')"
    under = f"COALESCE(type = 'bug' AND {rank('severity')} < {rank(floor)}, FALSE)"
    checks = f"(SELECT *, {schema} AS bad_fields, {at_line} AS line_ok, {source} AS source_ok, {over} AS over, {under} AS under FROM {fam} f)"
    conf = f"COALESCE(confidence, {n(0.75)}) * CASE WHEN bad_fields > 0 THEN {n(0.7)} ELSE {n(1.0)} END * CASE WHEN line_ok THEN {n(1.0)} ELSE {n(0.4)} END * CASE WHEN source_ok THEN {n(1.0)} ELSE {n(0.5)} END"
    wrong = f"(bad_fields + CASE WHEN line_ok THEN 0 ELSE 1 END + CASE WHEN source_ok THEN 0 ELSE 1 END + CASE WHEN over OR under THEN 1 ELSE 0 END)"
    scored = f"(SELECT *, {conf} AS conf, {wrong} AS violations FROM {checks} k)"
    return scored, f"((NOT line_ok AND type = 'bug' AND severity = 'high') OR (conf < {n(0.15)} AND violations >= 3))"


def firewall(d: Dialect, cases: str) -> str:
    """Claims checked against the code: each miss lowers confidence; a severe claim without evidence at its line goes."""
    n = d.num
    scored, dropped = _firewall_scored(d, cases, False)
    return f"""SELECT doc_id, seq, family, line_ok, source_ok, CAST(violations AS INT) AS violations, GREATEST({n(0.05)}, LEAST({n(0.98)}, conf)) AS confidence,
      CASE WHEN {dropped} THEN 'drop' WHEN over THEN 'downgrade' ELSE 'pass' END AS action, CASE WHEN over THEN 'low' ELSE severity END AS severity FROM {scored} s"""


def firewall_stats(d: Dialect, cases: str) -> str:
    k = lambda a: f"CAST(COUNT(CASE WHEN action = '{a}' THEN 1 END) AS BIGINT)"
    return f"SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total, {k('pass')} AS passed, {k('drop')} AS dropped, {k('downgrade')} AS downgraded FROM ({firewall(d, cases)}) f GROUP BY doc_id"


def contradictions(d: Dialect, issues: str) -> str:
    """Pairs of findings within five lines of which one says safe and the other vulnerable; the later of a pair is to go.

    Only findings that say one or the other are joined, on buckets of lines, each with its neighbour.
    """
    safe, vuln = d.any("explanation", [(p, "i") for p in V.SAFE_SIGNALS]), d.any("title", [(p, "i") for p in V.VULN_SIGNALS])
    # without a line, findings stand together: a pair of them counts as one line apart, any other pair as far apart
    told = f"(SELECT doc_id, seq, title, COALESCE(line, -999) AS spot, {safe} AS safe, {vuln} AS vuln FROM {issues})"
    one = f"(SELECT *, CAST(FLOOR(spot / {d.num(6.0)}) AS INT) AS b FROM {told} t WHERE safe OR vuln)"
    shifts = d.values(["shift"], [(-1,), (0,), (1,)])
    near = f"(SELECT a.*, a.b + s.shift AS nb FROM {one} a CROSS JOIN {shifts} s)"
    return f"""SELECT x.doc_id, x.seq AS a, y.seq AS b FROM {near} x JOIN {one} y ON x.doc_id = y.doc_id AND x.nb = y.b
      WHERE x.seq < y.seq AND ABS(x.spot - y.spot) <= 5 AND ((x.safe AND y.vuln) OR (y.safe AND x.vuln))"""


def mandatory_evidence(d: Dialect, issues: str) -> str:
    """Severe bugs need a line and a chain, a proof or a payload; those without become medium risks."""
    proof = "(length(COALESCE(exploit_chain, '')) > 20 OR COALESCE(sink_reachable, FALSE) OR length(COALESCE(exploit_payload, '')) > 10)"
    ok = f"(severity <> 'high' OR type <> 'bug' OR (COALESCE(line, 0) > 0 AND {proof}))"
    return f"SELECT doc_id, seq, {ok} AS passed, CASE WHEN {ok} THEN NULL WHEN COALESCE(line, 0) <= 0 THEN 'no line' ELSE 'no chain or payload' END AS reason, CASE WHEN {ok} THEN severity ELSE 'medium' END AS severity, CASE WHEN {ok} THEN type ELSE 'risk' END AS type FROM {issues}"


def minimize(d: Dialect, cases: str, keys: str = "doc_id, seq") -> str:
    """The first of six reasons to leave a finding out, or none. It depends on texts, severity, line and code alone."""
    ctx = lambda r: f"CASE WHEN line IS NULL THEN code ELSE {d.window('code', f'line - {r} + 1', f'line + {r}')} END"
    rows = f"(SELECT *, {C.minimizer_class(d)} AS cls, {ctx(25)} AS ctx, {ctx(5)} AS near, {d.size(d.lines('code'))} AS n_lines FROM {cases} c)"
    framework = " OR ".join(f"(cls IN ({', '.join(d.text(k) for k in kills)}) AND {d.match('code', p)})" for _, p, kills in V.MINIMIZER_FRAMEWORKS)
    reason = f"""CASE WHEN {d.any('code', V.MINIMIZER_TESTS)} THEN 'test code' WHEN n_lines > 80 AND ({framework}) THEN 'framework' WHEN {_by_class(d, 'cls', 'ctx', V.MINIMIZER_SANITIZERS)} THEN 'sanitizer'
      WHEN line IS NOT NULL AND {d.any('near', V.MINIMIZER_DEAD)} THEN 'dead code' WHEN severity <> 'high' AND {d.any('ctx', V.MINIMIZER_GATES)} THEN 'privilege gate'
      WHEN cls IN ('sqli', 'xss', 'cmd') AND {d.any('ctx', V.MINIMIZER_TYPES)} THEN 'type' END"""
    return f"SELECT {keys}, cls, {reason} AS reason FROM {rows} r"


def stages_kept(d: Dialect, cases: str) -> str:
    """(doc_id, k0, k1, k2): whether firewall, minimizer and policy keep a finding, of cases that have the columns of firewall_told() and the reason of minimize() already."""
    scored, dropped = _firewall_scored(d, cases, True)
    _, action, _ = _policy_cases(d, _policy_rules(None, "production", ()))
    return f"SELECT doc_id, NOT COALESCE({dropped}, FALSE) AS k0, reason IS NULL AS k1, COALESCE({action}, '') <> 'suppress' AS k2 FROM {scored} s"


def minimize_stats(d: Dialect, cases: str) -> str:
    return f"SELECT COALESCE(reason, 'active') AS reason, CAST(COUNT(*) AS BIGINT) AS n FROM ({minimize(d, cases)}) m GROUP BY COALESCE(reason, 'active')"


def proof(d: Dialect, cases: str) -> str:
    """Six obligations of a finding, weighed: source, sink, path, reachability, no sanitizer, feasible exploit."""
    n = d.num
    rows = f"(SELECT *, {C.proof_class(d)} AS cls, COALESCE(line, 0) AS spot, {d.size(d.lines('code'))} AS n_lines FROM {cases} c)"
    one = lambda t, x, other: "(CASE cls " + " ".join(f"WHEN '{k}' THEN {d.match(x, p)}" for k, p in t.items()) + f" ELSE {d.match(x, *other)} END)"
    guard = d.window("code", "GREATEST(0, spot - 20) + 1", "spot + 5")
    above, here = d.window("code", "GREATEST(0, spot - 5) + 1", "spot"), d.window("code", "spot", "spot")
    seen = f"(SELECT *, {guard} AS guard, {above} AS above, {here} AS here FROM {rows} r)"
    source = f"CASE WHEN cls IN ('hardcoded', 'generic') OR {one(V.PROOF_SOURCES, 'code', (r'req\.(body|query|params)',))} OR {d.match('code', r'def\s+\w+\s*\(\w')} THEN 'PROVED' ELSE 'FAILED' END"
    replay = lambda yes, no, other: f"CASE WHEN sink_reachable = TRUE THEN '{yes}' WHEN sink_reachable = FALSE THEN '{no}' ELSE {other} END"
    sink = replay("PROVED", "FAILED", f"CASE WHEN {one(V.PROOF_SINKS, 'code', (r'eval\s*\(|exec\s*\(',))} THEN 'PROVED' ELSE 'FAILED' END")
    path = replay("PROVED", "FAILED", f"CASE WHEN COALESCE(exploit_chain, '') <> '' OR {d.find('explanation', d.text('→'))} > 0 OR (spot > 0 AND spot <= n_lines) THEN 'PROVED' ELSE 'UNKNOWN' END")
    dead = f"({d.match('above', r'//\s*(TODO|FIXME|DEAD|UNREACHABLE|DISABLED|DEPRECATED|OLD|REMOVE)', 'i')} OR {d.match('here', r'if\s*\(\s*false\s*\)|while\s*\(\s*false\s*\)|return\s*;?\s*//')})"
    reach = replay("PROVED", "FAILED", f"CASE WHEN spot = 0 THEN 'UNKNOWN' WHEN {dead} THEN 'FAILED' ELSE 'PROVED' END")
    listed = f"({d.match('guard', r'subprocess\.\w+\s*\(\s*\[[\s\S]*?shell\s*=\s*False')} OR ({d.match('guard', r'subprocess\.\w+\s*\(\s*\[[\s\S]*?\)')} AND NOT {d.match('guard', r'shell\s*=\s*True')}))"
    clean = f"({one(V.PROOF_SANITIZERS, 'guard', ('sanitize|escape', 'i'))} OR (cls = 'command' AND {listed}))"
    free = f"CASE WHEN sink_reachable = TRUE THEN 'PROVED' WHEN sink_reachable = FALSE AND COALESCE(blocked_at, '') <> '' THEN 'FAILED' WHEN {clean} THEN 'FAILED' ELSE 'PROVED' END"
    chance = f"(COALESCE(confidence, {n(0.5)}) * {n(0.6)} + CASE WHEN COALESCE(exploit_payload, '') <> '' OR COALESCE(exploit_chain, '') <> '' THEN {n(0.4)} ELSE {n(0.0)} END)"
    feasible = replay("PROVED", "FAILED", f"CASE WHEN {chance} >= {n(0.5)} THEN 'PROVED' WHEN {chance} > {n(0.3)} THEN 'UNKNOWN' ELSE 'FAILED' END")
    parts = {"source_exists": (source, 25), "sink_exists": (sink, 25), "path_exists": (path, 20), "reachability": (reach, 10), "sanitizer_absent": (free, 15), "exploit_feasible": (feasible, 5)}
    told = f"(SELECT doc_id, seq, cls, confidence, {', '.join(f'{v} AS {k}' for k, (v, _) in parts.items())} FROM {seen} s)"
    total = " + ".join(f"CASE WHEN {k} = 'PROVED' THEN {w} ELSE 0 END" for k, (_, w) in parts.items())
    lost = " OR ".join(f"{k} = 'FAILED'" for k, (_, w) in parts.items() if w >= 20)
    status = f"CASE WHEN {lost} OR proved_pct < 35 THEN 'SUPPRESSED' WHEN proved_pct < 60 THEN 'WEAK' ELSE 'VALID' END"
    return f"""SELECT doc_id, seq, cls, {', '.join(parts)}, proved_pct, {status} AS status, CASE WHEN {status} = 'WEAK' THEN LEAST(COALESCE(confidence, {n(0.5)}), {n(0.65)}) ELSE confidence END AS confidence
      FROM (SELECT *, {total} AS proved_pct FROM {told} t) u"""


def proof_stats(d: Dialect, cases: str) -> str:
    k = lambda c: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    return f"""SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total, {k("status = 'VALID'")} AS valid, {k("status = 'WEAK'")} AS weak, {k("status = 'SUPPRESSED'")} AS suppressed, {k("status = 'SUPPRESSED' AND source_exists = 'FAILED'")} AS hallucinations
      FROM ({proof(d, cases)}) p GROUP BY doc_id"""


def dominance(d: Dialect, cases: str) -> str:
    """Verdict of the code on each finding. Protected classes with any evidence are locked; the rest goes by a score of evidence."""
    n = d.num
    text = "concat(title, ' ', explanation, ' ', category)"
    rows = f"(SELECT *, {C.dominance_class(d)} AS cls, {d.any(text, [(p, 'i') for p in V.PROTECTED])} AS protected, {d.size(d.lines('code'))} AS n_lines, {d.strip(d.window('code', 'line', 'line'))} AS target FROM {cases} c)"
    line_ok = "COALESCE(line > 0 AND line <= n_lines AND length(target) > 2, line IS NULL)"
    path = "(COALESCE(exploit_chain, '') <> '' OR sink_reachable IS NOT NULL OR length(explanation) > 50)"
    ev = f"(SELECT *, {_by_class(d, 'cls', 'code', V.DOMINANCE_SOURCES, 'sqli')} AS has_source, {_by_class(d, 'cls', 'code', V.DOMINANCE_SINKS, 'sqli')} AS has_sink, {line_ok} AS has_line, {path} AS has_path FROM {rows} r)"
    add = [("has_source", 30), ("has_sink", 30), ("has_line", 20), ("has_path", 10), ("COALESCE(exploit_verified, FALSE)", 10), ("protected", 20)]
    scored = f"(SELECT *, LEAST(100, {' + '.join(f'CASE WHEN {c} THEN {k} ELSE 0 END' for c, k in add)}) AS score FROM {ev} e)"
    logic = d.match("concat(title, explanation)", r"auth|idor|race|async|await|logic|business|privilege|permission|missing|ownership", "i")
    reject = f"(score = 0 AND length(COALESCE(exploit_chain, '')) <= 20 AND NOT COALESCE(exploit_verified, FALSE) AND COALESCE(line, 0) <= 0 AND NOT {logic})"
    verdict = f"CASE WHEN protected AND (has_source OR has_sink OR has_line) THEN 'DETERMINISTIC' WHEN score >= 70 THEN 'AI_CONFIRMED' WHEN score >= 40 THEN 'AI_ANNOTATED' WHEN {reject} THEN 'AI_REJECTED' ELSE 'AI_ANNOTATED' END"
    conf = f"""CASE WHEN verdict = 'DETERMINISTIC' THEN GREATEST(COALESCE(confidence, {n(0.8)}), {n(0.95)}) WHEN verdict IN ('AI_CONFIRMED', 'AI_REJECTED') THEN confidence
      ELSE LEAST(COALESCE(confidence, {n(0.7)}), CASE WHEN score >= 40 THEN {n(0.65)} WHEN score = 0 THEN {n(0.45)} ELSE {n(0.55)} END) END"""
    return f"SELECT doc_id, seq, cls, CAST(score AS INT) AS score, verdict, {conf} AS confidence FROM (SELECT *, {verdict} AS verdict FROM {scored} s) v"


def resurrect(d: Dialect, original: str, current: str) -> str:
    """Findings of the rules that a later stage lost: no current one has their line and start of title."""
    key = f"concat({_line()}, ':', {d.left('lower(title)', 30)})"
    return f"SELECT o.doc_id, o.seq, o.k, {d.num(0.98)} AS confidence FROM (SELECT doc_id, seq, {key} AS k FROM {original} x) o LEFT JOIN (SELECT DISTINCT doc_id, {key} AS k FROM {current} y) c ON o.doc_id = c.doc_id AND o.k = c.k WHERE c.k IS NULL"


def policy(d: Dialect, issues: str, packs: list[str] | None = None, env: str = "production", custom: Sequence[tuple] = ()) -> str:
    """The strongest action of the rules that match a finding, the last note, and the severity after it. packs: in order; None for all.

    custom: rules of one's own, after those of the packs: as V.POLICY_RULES with two fields more, a part of the title and a pattern of the column `path`, null for any.
    """
    rules = _policy_rules(packs, env, custom)
    if not rules:
        return f"SELECT doc_id, seq, '' AS rules, CAST(NULL AS VARCHAR(20)) AS action, CAST(NULL AS VARCHAR(200)) AS note, severity, FALSE AS blocked FROM {issues}"
    matched, action, note = _policy_cases(d, rules)
    rows = f"(SELECT doc_id, seq, severity, {matched} AS rules, {action} AS action, {note} AS note FROM {issues} i)"
    after = "CASE WHEN action = 'escalate' THEN CASE WHEN severity = 'low' THEN 'medium' ELSE 'high' END WHEN action = 'demote' THEN CASE WHEN severity = 'high' THEN 'medium' ELSE 'low' END ELSE severity END"
    return f"SELECT doc_id, seq, rules, action, note, {after} AS severity, COALESCE(action = 'require-fix', FALSE) AS blocked FROM {rows} r"


def _policy_rules(packs: list[str] | None, env: str, custom: Sequence[tuple]) -> list[tuple]:
    order = {p: i for i, p in enumerate(packs if packs is not None else dict.fromkeys(r[0] for r in V.POLICY_RULES))}
    rules = sorted((r for r in V.POLICY_RULES if r[0] in order and (r[8] is None or env in r[8].split(","))), key=lambda r: order[r[0]])
    return rules + [r for r in custom if r[8] is None or env in r[8].split(",")]


def _policy_cases(d: Dialect, rules: list[tuple]) -> tuple[str, str, str]:
    """The rules that match a finding, the strongest action and the last note of them."""
    when = []
    for _, _, category, severity, verified, below, _, _, _, *own in rules:
        title, path = own or (None, None)
        parts = []
        if title:
            parts.append(f"{d.find('lower(title)', d.text(title.lower()))} > 0")
        if path:
            parts.append(d.match("path", path))
        if severity:
            parts.append(f"severity = '{severity}'")
        if category:
            parts.append(f"{d.find('lower(category)', d.text(category))} > 0")
        if verified is not None:
            parts.append("exploit_verified = TRUE" if verified else "exploit_verified = FALSE")
        if below is not None:
            parts.append(f"COALESCE(confidence, {d.num(1.0)}) < {d.num(below)}")
        when.append(f"COALESCE({' AND '.join(parts) or 'TRUE'}, FALSE)")
    matched = d.labels([(w, r[1]) for w, r in zip(when, rules, strict=True)])
    action = "CASE " + " ".join(f"WHEN {w} THEN '{a}'" for a in V.POLICY_PRIORITY for w, r in zip(when, rules, strict=True) if r[6] == a) + " END"
    note = "CASE " + " ".join(f"WHEN {w} THEN {d.text(r[7])}" for w, r in reversed(list(zip(when, rules, strict=True))) if r[7]) + " END" if any(r[7] for r in rules) else "CAST(NULL AS VARCHAR(200))"
    return matched, action, note


def gate(d: Dialect, issues: str, packs: list[str] | None = None, env: str = "production") -> str:
    """Whether a document may be merged: no finding needs a fix, and none that is left is a severe bug. The first three titles tell why."""
    rows = f"(SELECT p.*, i.title, i.type, ROW_NUMBER() OVER (PARTITION BY p.doc_id, p.blocked ORDER BY p.seq) AS place FROM ({policy(d, issues, packs, env)}) p JOIN {issues} i ON p.doc_id = i.doc_id AND p.seq = i.seq)"
    n_blocked = "COUNT(CASE WHEN blocked THEN 1 END)"
    told = d.collect("CASE WHEN blocked AND place <= 3 THEN title END", "seq", "; ")
    severe = "COUNT(CASE WHEN type = 'bug' AND severity = 'high' AND COALESCE(action, '') <> 'suppress' THEN 1 END)"
    return f"SELECT doc_id, {n_blocked} = 0 AS policy_pass, {n_blocked} = 0 AND {severe} = 0 AS gate_pass, CAST({n_blocked} AS BIGINT) AS n_blocked, CAST({severe} AS BIGINT) AS n_severe, {told} AS reasons FROM {rows} r GROUP BY doc_id"


def check_fixes(d: Dialect, issues: str) -> str:
    """The reason that a proposed fix is refused, if any."""
    first = "CASE WHEN length(trim(fix)) < 3 THEN 'too short' " + " ".join(f"WHEN {d.match('fix', p, f)} THEN {d.text(r)}" for p, f, r in V.FORBIDDEN_FIXES) + " END"
    return f"SELECT doc_id, seq, fix, {first} AS refused FROM {issues} WHERE fix IS NOT NULL"


def team_suppressions(d: Dialect, issues: str, suppressions: str, now: str) -> str:
    """The first suppression in force whose pattern is part of a finding's title. suppressions: (id, pos, pattern, expires_at in seconds)."""
    live = f"(SELECT * FROM {suppressions} s WHERE expires_at IS NULL OR expires_at >= {now})"
    rows = f"(SELECT i.doc_id, i.seq, s.id, ROW_NUMBER() OVER (PARTITION BY i.doc_id, i.seq ORDER BY s.pos) AS place FROM {issues} i JOIN {live} s ON {d.find('lower(i.title)', 'lower(s.pattern)')} > 0)"
    return f"SELECT doc_id, seq, id AS suppression FROM {rows} r WHERE place = 1"


