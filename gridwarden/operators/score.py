"""Confidence, impact and routing scores."""

from __future__ import annotations

from ..functions import values as V
from ..functions.dialect import Dialect
from . import classify as C


def deduction(d: Dialect, other: int = 2) -> str:
    cases = " ".join(f"WHEN type = '{t}' AND severity = '{s}' THEN {n}" for t, by in V.DEDUCTIONS.items() for s, n in by.items())
    return f"(CASE {cases} ELSE {other} END)"


def plain_score(d: Dialect, issues: str) -> str:
    """100 less a penalty for each finding, per document."""
    penalty = "CASE WHEN type = 'suggestion' THEN 2 WHEN severity = 'high' THEN CASE WHEN type = 'bug' THEN 20 ELSE 12 END WHEN severity = 'medium' THEN CASE WHEN type = 'bug' THEN 10 ELSE 6 END WHEN type = 'bug' THEN 4 ELSE 3 END"
    return f"SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_issues, CAST(GREATEST(0, 100 - SUM({penalty})) AS BIGINT) AS score FROM {issues} GROUP BY doc_id"


def root_confidence(d: Dialect) -> str:
    """Percent, by steps in a fixed order, each capped."""
    n = d.num
    x = f"(CASE WHEN confidence IS NULL THEN {n(70.0)} WHEN confidence > 1 THEN confidence ELSE confidence * {n(100.0)} END)"
    steps = [
        ("exploit_verified = TRUE", "LEAST", 98.0, 15.0),
        ("exploit_verified = FALSE", "GREATEST", 20.0, -25.0),
        ("length(COALESCE(exploit_chain, '')) > 40", "LEAST", 95.0, 8.0),
        ("length(COALESCE(exploit_payload, '')) > 20", "LEAST", 95.0, 5.0),
        ("line IS NOT NULL", "LEAST", 95.0, 3.0),
        ("length(explanation) < 60", "GREATEST", 20.0, -15.0),
        ("COALESCE(fix, '') = '' AND COALESCE(fix_rejection_reason, '') = ''", "GREATEST", 20.0, -5.0),
    ]
    return steps, x


def with_root_confidence(d: Dialect, issues: str) -> str:
    """Findings with conf. Each step names the value before it once, so that the expression grows by steps, not powers."""
    steps, x = root_confidence(d)
    for when, bound, cap, add in steps:
        none = 1e9 if bound == "LEAST" else -1e9
        x = f"{bound}(CASE WHEN {when} THEN {d.num(cap)} ELSE {d.num(none)} END, {x} + CASE WHEN {when} THEN {d.num(add)} ELSE {d.num(0.0)} END)"
    return f"(SELECT *, {d.half_up(f'LEAST({d.num(98.0)}, GREATEST({d.num(10.0)}, {x}))')} AS conf FROM {issues} s)"


def bayes(d: Dialect, cases: str) -> str:
    """Posterior of each finding: a prior by class, multiplied by its evidence in order and clamped after each step."""
    near = d.window("code", "line - 4", "line + 5")
    ctx = f"(SELECT *, CASE WHEN line IS NULL OR line = 0 THEN '' ELSE {near} END AS ctx, {C.bayes_class(d)} AS vuln_class FROM {cases} c)"
    logic = d.match("concat(title, ' ', category)", r"auth|idor|race|async|await|logic|business|privilege|permission|missing|ownership|proto", "i")
    steps = [
        ("exploit_verified = TRUE", 3.0),
        ("sink_reachable = TRUE", 1.8),
        (d.match("ctx", r"req\.(body|query|params)|searchParams\.get|formData\.get"), 1.6),
        (d.match("ctx", r"db\.(query|execute)|innerHTML|eval\s*\(|exec\s*\(|readFile|redirect\s*\("), 1.5),
        (f"({d.match('ctx', r'db\.(query|execute|run)\s*\([^)]+,\s*\[')} OR {d.match('ctx', r'\$\d+')})", 0.05),
        (d.match("ctx", r"(?:session|isAuth|requireAuth|checkAuth)"), 0.15),
        (d.match("ctx", r"DOMPurify|encodeHTML|escapeHtml|parameterize|\$\d+|\?"), 0.20),
        (f"NOT {logic}", 0.60),
        (f"NOT {logic} AND NOT {d.match('ctx', r'req\.|searchParams|formData|params\.|headers\.')}", 0.40),
    ]
    p = d.lookup("vuln_class", V.BAYES_PRIORS, 0.50)
    for when, factor in steps:
        p = f"GREATEST({d.num(0.01)}, LEAST({d.num(0.97)}, {p} * CASE WHEN {when} THEN {d.num(factor)} ELSE {d.num(1.0)} END))"
    sql = f"(SELECT *, {p} AS posterior, {d.count_of(w for w, _ in steps)} AS n_steps FROM {ctx} x)"
    p, n = "posterior", "n_steps"
    level = f"CASE WHEN {p} >= {d.num(0.75)} THEN 'high' WHEN {p} >= {d.num(0.40)} THEN 'medium' ELSE 'low' END"
    rank = lambda x: f"(CASE {x} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END)"
    return f"""SELECT doc_id, seq, vuln_class, {p}, {d.half_up(f'{p} * {d.num(100.0)}')} AS confidence_pct, CAST({n} AS INT) AS n_steps, {level} AS new_severity,
      CASE WHEN {rank(level)} > {rank('severity')} THEN 'up' WHEN {rank(level)} < {rank('severity')} THEN 'down' ELSE 'same' END AS change FROM {sql} s"""


def bayes_stats(d: Dialect, cases: str) -> str:
    n = lambda c: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    mean = d.half_up("CAST(SUM(confidence_pct) AS DOUBLE) / COUNT(*)")
    return f"SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total, {n("change = 'up'")} AS upgraded, {n("change = 'down'")} AS downgraded, {mean} AS avg_confidence, {n(f'posterior >= {d.num(0.75)}')} AS high_confidence FROM ({bayes(d, cases)}) b GROUP BY doc_id"


def decay(d: Dialect, cases: str, threshold: float = 25.0) -> str:
    """Confidence multiplied down by sanitizers near the finding and by the context it is in."""
    ctx = f"(SELECT *, CASE WHEN line IS NULL THEN {d.left('code', 2000)} ELSE {d.window('code', 'line - 15', 'line + 15')} END AS ctx FROM {cases} c)"
    trust = [(d.match("ctx", p, f), t, name) for p, f, t, name in V.SANITIZERS]
    mods = [(f"({d.match('ctx', p, f)} OR {d.match('code', p, f)})", m, label) for p, f, m, label in V.CONTEXT_MODIFIERS]
    verified = f"CASE WHEN exploit_verified = TRUE THEN {d.num(1.5)} WHEN exploit_verified = FALSE THEN {d.num(0.5)} ELSE {d.num(1.0)} END"
    made = f"""(SELECT doc_id, seq, COALESCE(confidence, {d.num(0.75)}) * {d.num(100.0)} AS before, {d.product([x[:2] for x in trust])} AS trust, {d.product([x[:2] for x in mods])} * {verified} AS weight,
      {d.labels([(c, n) for c, _, n in trust], ', ')} AS sanitizers, {d.labels([(c, n) for c, _, n in mods], ', ')} AS modifiers FROM {ctx} x)"""
    after = f"(SELECT *, LEAST({d.num(98.0)}, GREATEST({d.num(0.0)}, before * trust * weight)) AS after FROM {made} m)"
    low = f"after < {d.num(threshold)}"
    has = lambda label: f"{d.find(d.join([d.text(''), 'modifiers', d.text('')], ', '), d.text(f', {label},'))} > 0"
    reason = f"CASE WHEN NOT {low} THEN NULL WHEN {has('dead-code')} THEN 'dead code' WHEN {has('dev-only')} THEN 'dev-only guard' WHEN sanitizers <> '' THEN 'sanitized' ELSE 'below threshold' END"
    return f"SELECT doc_id, seq, before, after, sanitizers, modifiers, {low} AS suppressed, {reason} AS reason FROM {after} a"


def decay_stats(d: Dialect, cases: str, threshold: float = 25.0) -> str:
    n = "COUNT(CASE WHEN suppressed THEN 1 END)"
    return f"SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS total, CAST({n} AS BIGINT) AS n_suppressed, {d.half_up(f'CAST({n} AS DOUBLE) / COUNT(*) * 100')} AS fp_reduction_pct FROM ({decay(d, cases, threshold)}) x GROUP BY doc_id"


def risk(d: Dialect, cases: str) -> str:
    """Business impact of each finding from signals in its file and around it, and the severity that it means."""
    near = d.window("code", "GREATEST(0, COALESCE(line, 0) - 20) + 1", f"COALESCE(line, {d.size(d.lines('code'))}) + 20")
    ctx = f"(SELECT *, {near} AS ctx FROM {cases} c)"
    s = {k: d.any("ctx" if k == "lateral_movement" else "code", p) for k, p in V.RISK_SIGNALS.items()}
    for k in ("authenticated", "admin_only"):
        s[k] = f"({d.any('ctx', V.RISK_SIGNALS[k])} OR {s[k]})"
    flags = f"(SELECT doc_id, seq, type, severity, {', '.join(f'{v} AS {k}' for k, v in s.items())} FROM {ctx} x)"
    add = [("internet_reachable", 20), ("NOT authenticated", 15), ("cloud_credentials", 15), ("secrets_accessible", 10), ("lateral_movement", 10), ("sensitive_data", 8), ("NOT development", 5), ("authenticated", -15), ("admin_only", -15), ("development", -20)]
    total = f"(SELECT *, GREATEST(0, LEAST(100, 40 + {' + '.join(f'CASE WHEN {c} THEN {n} ELSE 0 END' for c, n in add)})) AS impact FROM {flags} f)"
    level = "CASE WHEN impact >= 65 THEN 'high' WHEN impact >= 35 THEN 'medium' ELSE 'low' END"
    why = d.labels(
        [
            ("internet_reachable AND NOT authenticated", "unauthenticated internet exposure"), ("internet_reachable AND authenticated", "internet-reachable"), ("cloud_credentials", "cloud credentials on path"), ("secrets_accessible", "secrets accessible"),
            ("lateral_movement", "lateral movement possible"), ("sensitive_data", "PII/sensitive data"), ("admin_only", "admin-only route (reduced exposure)"), ("development", "non-production code"),
        ], ", ",
    )
    return f"""SELECT doc_id, seq, CAST(impact AS INT) AS impact, {level} AS adjusted, {why} AS factors,
      CASE WHEN severity = 'high' AND {level} <> 'high' THEN 'down' WHEN severity = 'low' AND {level} <> 'low' THEN 'up' ELSE 'same' END AS change
      FROM {total} t WHERE type <> 'suggestion'"""


def weighted_score(d: Dialect, cases: str) -> str:
    """Score of each document: deductions by type, weighed by context and rounded one by one, less rewards for good practice."""
    n = d.num
    fam = C.cluster_family(d)
    # the kept one of a family is the first with the highest confidence; others of a family of several count a tenth, by line and start of title
    ranked = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, fam ORDER BY COALESCE(confidence, 0) DESC, seq) AS place FROM (SELECT *, {fam} AS fam, concat(COALESCE(CAST(line AS VARCHAR(12)), 'null'), ':', {d.left('title', 30)}) AS k FROM {cases} c) x)"
    marked = f"(SELECT *, MAX(CASE WHEN place > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k) AS is_copy FROM {ranked} r)"
    reach = "COALESCE(reachability, 100)"
    by_reach = f"CASE WHEN {reach} < 10 THEN {n(0.0)} WHEN {reach} < 20 THEN {n(0.2)} WHEN {reach} < 50 THEN {n(0.4)} WHEN {reach} < 70 THEN {n(0.6)} WHEN {reach} >= 90 THEN {n(1.3)} ELSE {n(1.0)} END"
    factor = f"CASE WHEN is_copy = 1 THEN {n(0.1)} ELSE {n(1.0)} END * CASE WHEN exploit_verified = TRUE THEN {n(1.5)} ELSE {n(1.0)} END * {by_reach} * CASE WHEN confidence < {n(0.5)} THEN {n(0.3)} ELSE {n(1.0)} END"
    reward = " + ".join(f"CASE WHEN {d.match('code', p, f)} THEN {r} ELSE 0 END" for p, f, r, _ in V.REWARDS)
    rows = f"(SELECT doc_id, code, {deduction(d)} AS base, {d.half_up(f'{deduction(d)} * ({factor})')} AS final FROM {marked} m)"
    sums = f"(SELECT doc_id, MIN(code) AS code, CAST(SUM(base) AS BIGINT) AS base_deductions, CAST(SUM(final) AS BIGINT) AS adjusted_deductions FROM {rows} s GROUP BY doc_id)"
    told = f"(SELECT *, {reward} AS rewards FROM {sums} t)"
    return f"SELECT doc_id, base_deductions, adjusted_deductions, CAST(rewards AS BIGINT) AS rewards, CAST(GREATEST(0, LEAST(100, 100 - adjusted_deductions + LEAST(rewards, 20))) AS BIGINT) AS score FROM {told} u"


def route(d: Dialect, files: str, hits: str) -> str:
    """How much review a file gets: tier and token budgets. hits: (doc_id, rule_hits, taint_flows)."""
    n = d.num
    counted = lambda rows: "(" + " + ".join(f"CASE WHEN {d.match('code', p, f)} THEN {c} ELSE 0 END" for p, f, c in rows) + ")"
    frameworks = d.count_of(c for c, _ in C.router_frameworks(d))
    signals = f"""(SELECT f.doc_id, {d.size(d.lines('code'))} AS line_count, COALESCE(h.rule_hits, 0) AS hits, COALESCE(h.taint_flows, 0) AS flows, {counted(V.ROUTER_SINKS)} + {counted(V.ROUTER_SOURCES)} AS sinks,
      {d.any('code', V.ROUTER_CRITICAL)} AS critical, {d.any('code', V.ROUTER_AUTH)} AS auth, {d.any('code', V.ROUTER_SECRETS)} AS secrets, {d.any('code', V.ROUTER_ADMIN)} AS admin, {frameworks} AS frameworks
      FROM {files} f LEFT JOIN {hits} h ON f.doc_id = h.doc_id)"""
    score = f"LEAST({n(25.0)}, line_count / {n(20.0)}) + LEAST(20, hits * 3) + LEAST(15, flows * 4) + LEAST(10, sinks * 2) + CASE WHEN critical THEN 15 ELSE 0 END + CASE WHEN auth THEN 10 ELSE 0 END + CASE WHEN secrets THEN 8 ELSE 0 END + CASE WHEN admin THEN 7 ELSE 0 END + frameworks * 2"
    scored = f"(SELECT *, LEAST(100, {d.half_up(score)}) AS complexity FROM {signals} s)"
    tier = """CASE WHEN (critical AND flows >= 2 AND hits >= 3) OR (auth AND secrets AND hits >= 2) OR complexity >= 75 THEN 'adversarial-full'
      WHEN flows >= 2 OR hits >= 3 OR (auth AND hits >= 1) OR complexity >= 40 THEN 'triple-consensus'
      WHEN flows >= 1 OR hits >= 1 OR sinks >= 2 OR complexity >= 20 OR line_count <= 80 THEN 'single-reviewer' ELSE 'deterministic-only' END"""
    tiered = f"(SELECT *, {tier} AS tier, LEAST({n(2.0)}, GREATEST({n(1.0)}, 1 + line_count / {n(300.0)})) AS size_factor FROM {scored} c)"
    by = lambda a, b, c: f"CASE tier WHEN 'single-reviewer' THEN {a} WHEN 'triple-consensus' THEN {b} WHEN 'adversarial-full' THEN {c} ELSE 0 END"
    size = lambda x: d.half_up(f"{x} * size_factor")
    return f"""SELECT doc_id, CAST(line_count AS INT) AS line_count, CAST(sinks AS INT) AS sinks, CAST(frameworks AS INT) AS frameworks, CAST(complexity AS BIGINT) AS complexity, tier,
      CAST({by(f'GREATEST(1200, {size(1000)})', f'GREATEST(1400, {size(1400)})', f'GREATEST(1800, {size(2000)})')} AS BIGINT) AS tokens_per_role,
      CAST({by(size(3000), size(5000), size(8000))} AS BIGINT) AS diff_tokens, {by(1, 3, 5)} AS max_roles FROM {tiered} t"""
