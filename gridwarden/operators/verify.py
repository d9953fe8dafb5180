"""Findings tried against the code: simulated payloads, replays, chains of conditions, guards, fixes; and what is known of their class."""

from __future__ import annotations

from ..functions import verify_values as V
from ..functions.dialect import Dialect
from . import classify as C
from . import lines as L


def _rows(d: Dialect, made: list[str], item: str = "x", pos: str = "nth") -> str:
    """SQL for an array of the strings that are not null."""
    return f"filter(array({', '.join(made)}), {item} -> {item} IS NOT NULL)" if d.name == "spark" else f"list_filter([{', '.join(made)}], lambda {item}: {item} IS NOT NULL)"


def payloads(d: Dialect, cases: str) -> str:
    """The verdict of the most telling payload for each finding: of equal confidences the first, and none after one that gets through."""
    words = "concat(lower(category), ' ', lower(title))"
    wants = {c: "(" + " OR ".join(f"{d.find(words, d.text(w))} > 0" for w, cs in V.PAYLOAD_WORDS.items() if c in cs) + ")" for c in dict.fromkeys(p[0] for p in V.PAYLOADS)}
    near = d.window("code", "GREATEST(1, spot - 20)", "spot + 20")
    guard = d.window("code", "GREATEST(1, spot - 15)", "spot + 15")
    # windows by lines of their own: distance of up to 20 and 15 lines; a finding without a line counts as line 0
    rows = f"(SELECT *, {near} AS near, {d.match(guard, V.PAYLOAD_SANITIZER)} AS cleaned FROM (SELECT *, COALESCE(line, 0) AS spot FROM {cases} c WHERE severity <> 'low' OR type = 'bug') s)"
    verdict = lambda p, f, b: f"CASE WHEN NOT {d.match('code', p, f)} THEN 'UNREACHABLE' WHEN cleaned{(' OR ' + d.match('code', b)) if b else ''} THEN 'BLOCKED' WHEN {d.match('near', p, f)} THEN 'VERIFIED' ELSE 'PARTIAL' END"
    tried = ", ".join(f"CASE WHEN {wants[c]} THEN {verdict(p, f, b)} END AS v{i}" for i, (c, p, f, b) in enumerate(V.PAYLOADS))
    told = f"(SELECT doc_id, seq, severity, {tried} FROM {rows} r)"
    conf = lambda x: f"CASE {x} WHEN 'UNREACHABLE' THEN 85 WHEN 'VERIFIED' THEN 80 WHEN 'BLOCKED' THEN 75 WHEN 'PARTIAL' THEN 55 END"
    # of verdicts in order: what gets through ends the trial, and no sink at all is surer than that; so the first of these two decides, else the surest
    v = [f"v{i}" for i in range(len(V.PAYLOADS))]
    first = ", ".join(f"CASE WHEN {x} IN ('VERIFIED', 'UNREACHABLE') THEN {x} END" for x in v)
    some = lambda k: f"CASE WHEN {' OR '.join(f'COALESCE({x}, {d.text(chr(45))}) = {d.text(k)}' for x in v)} THEN '{k}' END"
    sql, b = f"(SELECT doc_id, seq, severity, COALESCE({first}, {some('BLOCKED')}, {some('PARTIAL')}) AS verdict FROM {told} t)", "verdict"
    after = f"CASE WHEN {b} = 'VERIFIED' THEN 'high' WHEN {b} = 'UNREACHABLE' THEN 'low' WHEN {b} = 'BLOCKED' THEN CASE severity WHEN 'high' THEN 'medium' ELSE 'low' END ELSE severity END"
    return f"SELECT doc_id, seq, {b}, {conf(b)} AS confidence_pct, {after} AS severity FROM {sql} z WHERE {b} IS NOT NULL"


def payload_stats(d: Dialect, cases: str) -> str:
    return f"SELECT verdict, CAST(COUNT(*) AS BIGINT) AS n FROM ({payloads(d, cases)}) p GROUP BY verdict"


def replays(d: Dialect, cases: str) -> str:
    """Each finding with a line replayed by its class: the sink is reached if it stands near and nothing safe does."""
    fam = f"(SELECT *, CASE WHEN {d.match('title', 'division', 'i')} THEN 'division-by-zero' ELSE {C.root_family(d)} END AS family FROM {cases} c WHERE line IS NOT NULL)"
    kinds = ", ".join(d.text(k) for k in V.REPLAYS)
    by = lambda f, other: "CASE family " + " ".join(f"WHEN '{k}' THEN {f(k, r)}" for k, r in V.REPLAYS.items()) + f" ELSE {other} END"
    radius = by(lambda k, r: r[0], 0)
    rows = f"(SELECT doc_id, seq, family, {d.window('code', 'line - r', 'line + r')} AS ctx FROM (SELECT *, {radius} AS r FROM {fam} f WHERE family IN ({kinds})) g)"
    safe, sink = by(lambda k, r: d.any("ctx", r[1]), "FALSE"), by(lambda k, r: d.any("ctx", r[2]), "FALSE")
    told = f"(SELECT doc_id, seq, family, {safe} AS safe, {sink} AS sink FROM {rows} x)"
    conf = by(lambda k, r: f"CASE WHEN sink AND NOT safe THEN {r[3]} ELSE {r[4]} END", 0)
    return f"SELECT doc_id, seq, family, sink AND NOT safe AS reachable, safe AS blocked, {conf} AS confidence_pct FROM {told} t"


def grades(d: Dialect, cases: str) -> str:
    """How good the sanitizer near a finding is: the first that is found."""
    ctx = f"(SELECT doc_id, seq, {d.window('code', 'line - 4', 'line + 4')} AS ctx FROM {cases} c WHERE line IS NOT NULL)"
    return f"SELECT doc_id, seq, {d.first('ctx', [(p, g, f) for p, f, g in V.GRADES], 'unknown')} AS grade FROM {ctx} x"


def constraint_chains(d: Dialect, cases: str) -> str:
    """The first chain template that a finding starts: how many of its steps the file confirms, where it breaks, and what that makes it."""
    n = d.num
    text = "lower(concat(title, ' ', explanation))"
    which = "CASE " + " ".join("WHEN " + " OR ".join(f"{d.find(text, d.text(w))} > 0" for w in words) + f" THEN {i}" for i, (_, words, _, _) in enumerate(V.CHAINS)) + " END"

    def holds(kind: str, patterns: list) -> str:
        if kind == "always":
            return "TRUE"
        if kind == "auth text":
            return f"({d.find('lower(explanation)', d.text('auth'))} > 0 OR category = 'security')"
        return f"{'NOT ' if kind == 'absent' else ''}{d.any('code', patterns)}"

    most = max(len(c[3]) for c in V.CHAINS)
    steps = []
    for k in range(most):
        steps.append("CASE chain " + " ".join(f"WHEN {i} THEN CASE WHEN {holds(*c[3][k])} THEN 1 ELSE 0 END" for i, c in enumerate(V.CHAINS) if k < len(c[3])) + f" END AS h{k}")
    rows = f"(SELECT doc_id, seq, line, confidence, chain, {', '.join(steps)} FROM (SELECT *, {which} AS chain FROM {cases} c) x WHERE chain IS NOT NULL)"
    hit = " + ".join(f"COALESCE(h{k}, 0)" for k in range(most))
    size = "CASE chain " + " ".join(f"WHEN {i} THEN {len(c[3])}" for i, c in enumerate(V.CHAINS)) + " END"
    counted = f"(SELECT *, {hit} AS hits, {size} AS hops, CASE {' '.join(f'WHEN h{k} = 0 THEN {k + 1}' for k in range(most))} END AS blocked_at FROM {rows} r)"
    conf = d.half_up(f"(CAST(hits AS DOUBLE) / hops) * 70 + COALESCE(confidence, {n(0.7)}) * 20 + CASE WHEN hits = hops THEN 10 ELSE 0 END")
    scored = f"(SELECT *, {conf} AS chain_confidence FROM {counted} k)"
    base = "CASE chain " + " ".join(f"WHEN {i} THEN {n(c[2] / 10)}" for i, c in enumerate(V.CHAINS)) + " END"
    name = "CASE chain " + " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(V.CHAINS)) + " END"
    tenths = d.half_up(f"{base} * (chain_confidence / {n(100.0)}) * 10")
    return f"SELECT doc_id, seq, {name} AS chain, hits, hops, blocked_at, chain_confidence, {tenths} AS cvss_tenths, {tenths} >= 80 AND hits * 2 >= hops AS critical FROM {scored} s"


def knowledge(d: Dialect, cases: str) -> str:
    """Weakness class of each finding, and vulnerabilities and exploits that its file shows; a critical one raises severity."""
    text = "lower(concat(title, ' ', category, ' ', explanation))"
    explicit = f"upper({d.extract('concat(title, chr(32), explanation)' if d.name == 'duck' else 'concat(title, char(32), explanation)', r'\bCWE-\d+\b', 0, 'i')})"
    known = ", ".join(d.text(k) for k in V.CWES)
    cwe = f"CASE WHEN {explicit} <> '' THEN CASE WHEN {explicit} IN ({known}) THEN {explicit} END ELSE {d.first(text, V.CWE_WORDS, None)} END"
    cves = d.labels([(d.match("code", p), i) for i, _, p in V.CVES])
    worst = "GREATEST(0, " + ", ".join(f"CASE WHEN {d.match('code', p)} THEN {s} ELSE 0 END" for _, s, p in V.CVES) + ")"
    exploits = d.labels([(d.match("code", p), f) for f, _, _, p in V.FRAMEWORK_EXPLOITS])
    bypass = d.labels(
        [
            (f"{d.match('code', 'encodeURIComponent')} AND {d.match('code', 'href|src|url', 'i')}", "encodeURIComponent"), (f"{d.match('code', r'\.includes\s*\(')} AND {d.match('category', 'ssrf|redirect', 'i')}", "includes"),
            (f"{d.match('code', r'path\.normalize')} AND {d.match('category', 'path|traversal', 'i')}", "path.normalize"),
        ]
    )
    rows = f"(SELECT doc_id, seq, severity, {cwe} AS cwe, {cves} AS cves, {worst} AS worst, {exploits} AS exploits, {bypass} AS bypasses FROM {cases} c)"
    return f"SELECT doc_id, seq, cwe, {d.lookup('cwe', {k: v[0] for k, v in V.CWES.items()})} AS cwe_name, cves, exploits, bypasses, CASE WHEN worst >= 90 THEN 'high' ELSE severity END AS severity FROM {rows} r"


def knowledge_stats(d: Dialect, cases: str) -> str:
    k = lambda c: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    return f"SELECT CAST(COUNT(*) AS BIGINT) AS total, {k('cwe IS NOT NULL')} AS cwe_matched, {k('cves <> ' + d.text(''))} AS cve_matched, {k('exploits <> ' + d.text(''))} AS exploit_matched FROM ({knowledge(d, cases)}) x"


def symbolic_guards(d: Dialect, lines: str) -> str:
    """Guards by the first kind that a line matches, and how many lines on they reach at most."""
    kind = "CASE " + " ".join(f"WHEN {d.match('raw', p, f)} THEN '{k}:{r}'" for p, f, k, r in V.SYMBOLIC_GUARDS) + " END"
    rows = f"(SELECT doc_id, line_no, indent, {kind} AS k FROM {lines} l)"
    return f"SELECT doc_id, line_no, indent, {d.extract('k', '^([a-z]+)', 1)} AS kind, CAST({d.extract('k', '([0-9]+)', 1)} AS INT) AS reach FROM {rows} r WHERE k IS NOT NULL"


def symbolic_paths(d: Dialect, lines: str, tainted: str) -> str:
    """Sinks that taint is on, each with the strongest guard that still holds there: one before it, in reach, without a closing brace less deep in between."""
    sink = d.first("raw", V.SYMBOLIC_SINKS, None, "")
    names = f"(SELECT doc_id, {'collect_list(var)' if d.name == 'spark' else 'list(var)'} AS names FROM {tainted} t GROUP BY doc_id)"
    from .taint import _some_in

    sinks = f"(SELECT * FROM (SELECT l.doc_id, l.line_no, {sink} AS sink_type, {_some_in(d, 'n.names', 'l.raw')} AS hot FROM {lines} l LEFT JOIN {names} n ON l.doc_id = n.doc_id) x WHERE sink_type IS NOT NULL AND (hot OR sink_type = 'eval'))"
    guards = f"({symbolic_guards(d, lines)})"
    closing = f"(SELECT doc_id, line_no, indent FROM {lines} l WHERE {d.left('trimmed', 1)} = '}}')"
    ends = L._ends(d, f"(SELECT doc_id, line_no, indent FROM {guards} lg WHERE reach > 20)", closing, True)
    spans = f"(SELECT g.doc_id, g.line_no, g.kind, LEAST(g.line_no + g.reach, COALESCE(e.until, 2147483647)) AS until FROM {guards} g LEFT JOIN {ends} e ON g.doc_id = e.doc_id AND g.line_no = e.line_no)"
    rank = d.lookup("g.kind", V.SYMBOLIC_PRIORITY, 0)
    joined = f"(SELECT s.*, g.line_no AS guard_line, g.kind, ROW_NUMBER() OVER (PARTITION BY s.doc_id, s.line_no ORDER BY COALESCE({rank}, -1) DESC, g.line_no) AS place, COALESCE({rank}, -1) AS pr FROM {sinks} s LEFT JOIN {spans} g ON s.doc_id = g.doc_id AND s.line_no > g.line_no AND s.line_no <= g.until)"
    conf = "CASE WHEN kind IS NULL THEN CASE WHEN hot THEN 85 ELSE 50 END ELSE GREATEST(10, 85 - pr * 15) END"
    return f"SELECT doc_id, CAST(line_no AS INT) AS line_no, sink_type, kind IS NULL AS reachable, kind AS guard, CAST(guard_line AS INT) AS guard_line, {conf} AS confidence_pct FROM {joined} j WHERE place = 1"


def apply_paths(d: Dialect, issues: str, paths: str) -> str:
    """Findings within two lines of a sink: kept, toned down behind a login, or suppressed behind another guard.

    Lines are joined on buckets of three and their neighbours; the first sink counts.
    """
    shifts = d.values(["shift"], [(-1,), (0,), (1,)])
    bucket = lambda x: f"CAST(FLOOR({x} / {d.num(3.0)}) AS INT)"
    near = f"(SELECT p.*, {bucket('p.line_no')} + s.shift AS b FROM {paths} p CROSS JOIN {shifts} s)"
    joined = f"(SELECT i.doc_id, i.seq, i.type, i.severity, p.reachable, p.guard, ROW_NUMBER() OVER (PARTITION BY i.doc_id, i.seq ORDER BY p.line_no) AS place FROM {issues} i JOIN {near} p ON i.doc_id = p.doc_id AND {bucket('i.line')} = p.b AND ABS(p.line_no - i.line) <= 2)"
    action = "CASE WHEN reachable THEN 'keep' WHEN guard = 'auth' AND type = 'bug' AND severity = 'high' THEN 'tone down' ELSE 'suppress' END"
    return f"SELECT doc_id, seq, {action} AS action, guard FROM {joined} j WHERE place = 1"


def remediation(d: Dialect, cases: str) -> str:
    """Whether a fix holds: the file with the finding's line replaced by its fix, looked at around that line."""
    low, high = d.window("code", "1", "line - 1"), d.window("code", "line + 1", "1000000000")
    nl = "'\\n'" if d.name == "spark" else "chr(10)"
    patched = f"(SELECT *, concat({low}, {nl}, fix, {nl}, {high}) AS patched FROM {cases} c WHERE COALESCE(fix, '') <> '' AND line IS NOT NULL)"
    ctx = f"(SELECT *, {d.window('patched', 'line - 2', 'line + 5')} AS ctx FROM {patched} p)"
    m = lambda p, f="": d.match("ctx", p, f)
    fresh = " OR ".join(f"({d.match('patched', p, f)} AND NOT {d.match('code', p, f)})" for p, f in V.BYPASSES)
    has = lambda w, t: f"({d.find('lower(category)', d.text(w))} > 0 OR {d.find('lower(title)', d.text(t))} > 0)"
    sql = f"CASE WHEN {m(r'db\.(?:query|execute|run)\s*\([^)]+,\s*\[')} OR {m(r'\$\d+')} OR {m(r'\?')} OR {m(r'prepare\s*\(')} THEN 'FIXED' WHEN {m(r'`[^`]*(?:SELECT|WHERE|INSERT)[^`]*\$\{')} THEN 'PARTIAL' WHEN {m(r'''['\"][^'\"]*(?:SELECT|WHERE)[^'\"]*['\"]\s*\+''')} THEN 'BYPASSED' ELSE 'UNVERIFIED' END"
    xss = f"CASE WHEN {m(r'DOMPurify\.sanitize|encodeHTML|escapeHtml|textContent\s*=')} THEN 'FIXED' WHEN {m('innerHTML')} THEN 'PARTIAL' ELSE 'UNVERIFIED' END"
    cmd = f"CASE WHEN {m(r'spawn\s*\([^)]*,\s*\[')} AND NOT {m(r'shell\s*:\s*true')} THEN 'FIXED' WHEN NOT {m(r'(exec|execSync)\s*\(')} AND {d.match('code', r'(exec|execSync)\s*\(')} THEN 'FIXED' WHEN {m(r'exec\s*\(`')} THEN 'PARTIAL' ELSE 'UNVERIFIED' END"
    path = f"CASE WHEN {m(r'path\.resolve\s*\(')} AND {m(r'startsWith\s*\(')} THEN 'FIXED' WHEN {m(r'path\.normalize\s*\(')} AND NOT {m(r'startsWith\s*\(')} THEN 'PARTIAL' ELSE 'UNVERIFIED' END"
    proto = f"CASE WHEN {m('__proto__')} AND {m('constructor')} AND {m('prototype')} THEN 'FIXED' WHEN {m('__proto__')} OR {m(r'Object\.keys')} THEN 'PARTIAL' ELSE 'UNVERIFIED' END"
    status = f"CASE WHEN {fresh} THEN 'BYPASSED' WHEN {has('sql', 'sql')} THEN {sql} WHEN {has('xss', 'xss')} THEN {xss} WHEN {has('cmd', 'command')} THEN {cmd} WHEN {has('path', 'traversal')} THEN {path} WHEN {has('proto', 'prototype')} THEN {proto} ELSE 'UNVERIFIED' END"
    return f"SELECT doc_id, seq, status, CASE status WHEN 'FIXED' THEN 90 WHEN 'PARTIAL' THEN 65 WHEN 'BYPASSED' THEN 92 ELSE 70 END AS confidence_pct, regression FROM (SELECT doc_id, seq, {status} AS status, ({fresh}) AS regression FROM {ctx} x) y"


def semantic_routes(d: Dialect, lines: str) -> str:
    """Routes of four frameworks, each with whether it asks for a login, is public, and the first sensitive sink in its 30 lines."""
    rows = f"""(SELECT *, {d.near('raw', 'doc_id', 'line_no', 0, 2)} AS next3, {d.near('raw', 'doc_id', 'line_no', 2, 9)} AS around12, {d.near('raw', 'doc_id', 'line_no', 5, 14)} AS around20, {d.near('raw', 'doc_id', 'line_no', 0, 29)} AS body,
      {d.near('raw', 'doc_id', 'line_no', 30, 0)} AS before FROM {lines} l)"""
    auth = lambda x: d.any(x, V.ROUTE_AUTH)
    up = lambda p: f"upper({d.extract('raw', p, 1, 'i')})"
    hidden = lambda x: f"({d.find(x, d.text('/internal'))} > 0 OR {d.find(x, d.text('/admin'))} > 0)"
    first_app = f"CASE WHEN {d.extract('before', r'/app/([^/\s]+)', 1)} <> '' THEN concat('/', {d.extract('before', r'/app/([^/\s]+)', 1)}) ELSE '/api/route' END"
    kinds = [
        ("express", V.EXPRESS_ROUTE, "i", up(V.EXPRESS_ROUTE), d.extract("raw", V.EXPRESS_ROUTE, 2, "i"), auth("next3"), True, "TRUE"),
        ("flask", V.FLASK_ROUTE, "i", f"CASE WHEN {up(V.FLASK_ROUTE)} = 'ROUTE' THEN 'ANY' ELSE {up(V.FLASK_ROUTE)} END", d.extract("raw", V.FLASK_ROUTE, 2, "i"), f"({auth('around12')} OR {d.match('around12', r'@login_required|@permission_required|current_user\.is_authenticated')})", True, "TRUE"),
        ("fastapi", V.FASTAPI_ROUTE, "i", up(V.FASTAPI_ROUTE), d.extract("raw", V.FASTAPI_ROUTE, 2, "i"), d.match("around12", r"Depends\s*\(.*(?:auth|token|user|get_current)", "i"), False, f"NOT {d.match('raw', V.FLASK_ROUTE, 'i')}"),
        ("next", V.NEXT_ROUTE, "", d.extract("raw", V.NEXT_ROUTE, 1), first_app, auth("around20"), False, "TRUE"),
    ]
    sink = d.first("body", V.ROUTE_SINKS, None, "")
    parts = []
    for name, p, f, method, path, login, hide, cond in kinds:
        public = f"NOT login AND NOT {hidden('path')}" if hide else "NOT login"
        parts.append(f"SELECT doc_id, line_no, '{name}' AS framework, method, path, login, {public} AS is_public, CASE WHEN {public} THEN sink END AS gap FROM (SELECT doc_id, line_no, {method} AS method, {path} AS path, {login} AS login, {sink} AS sink FROM {rows} r WHERE {d.match('raw', p, f)} AND {cond}) {name}")
    return " UNION ALL ".join(parts)


def route_middleware(d: Dialect, lines: str) -> str:
    """(doc_id, line_no, method, path, place, name, is_auth, is_validation): what stands between path and handler where a route is registered by a call, in order from 0."""
    rows = f"(SELECT *, {d.near('raw', 'doc_id', 'line_no', 0, 2)} AS chunk FROM {lines} l)"
    split = "split" if d.name == "spark" else "string_split"
    args = f"(SELECT doc_id, line_no, upper({d.extract('raw', V.EXPRESS_ROUTE, 1, 'i')}) AS method, {d.extract('raw', V.EXPRESS_ROUTE, 2, 'i')} AS path, {split}({d.extract('chunk', V.ROUTE_ARGUMENTS, 1)}, ',') AS args FROM {rows} r WHERE {d.match('raw', V.EXPRESS_ROUTE, 'i')})"
    sized = f"(SELECT *, {d.size('args')} AS n_args FROM {args} a)"
    each = d.explode(f"{sized} s", "args", "arg", "pos", "doc_id, line_no, method, path, n_args")
    named = f"(SELECT *, {d.strip('arg')} AS name FROM {each} e WHERE pos > 1 AND pos < n_args)"
    told = f"(SELECT * FROM {named} n WHERE name <> '' AND NOT {d.match('name', '^[' + chr(39) + chr(34) + '`]')})"
    return f"SELECT doc_id, line_no, method, path, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, line_no ORDER BY pos) - 1 AS INT) AS place, name, {d.any('name', V.ROUTE_AUTH)} AS is_auth, {d.any('name', V.ROUTE_VALIDATION)} AS is_validation FROM {told} t"


def route_order(d: Dialect, lines: str) -> str:
    """Routes that check what is sent before they check who sends it."""
    first = lambda c: f"MIN(CASE WHEN {c} THEN place END)"
    rows = f"(SELECT doc_id, line_no, method, path, {first('is_auth')} AS auth, {first('is_validation')} AS checked FROM ({route_middleware(d, lines)}) m GROUP BY doc_id, line_no, method, path)"
    return f"SELECT doc_id, CAST(line_no AS INT) AS line, 'medium' AS severity, {d.num(0.65)} AS confidence, method, path FROM {rows} r WHERE auth > 0 AND checked < auth"


def semantic_summary(d: Dialect, lines: str) -> str:
    k = lambda c: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    return f"SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS routes, {k('is_public')} AS public_routes, {k('gap IS NOT NULL')} AS auth_gaps FROM ({semantic_routes(d, lines)}) r GROUP BY doc_id"


def semantic_chains(d: Dialect, files: str, routes: str) -> str:
    """Ways through a program from outside to what is worth guarding: open routes with a gap, and code that takes input and has sinks without any login. routes: semantic_routes()."""
    sinks = d.labels([(d.match("code", p), label) for p, label in V.ROUTE_SINKS], ", ")
    whole = f"(SELECT doc_id, {sinks} AS sinks FROM {files} f WHERE {d.any('code', V.ROUTE_SOURCES)} AND NOT {d.any('code', V.ROUTE_AUTH)})"
    number = "CAST(line_no AS VARCHAR(12))"
    return f"""SELECT doc_id, CAST(line_no AS INT) AS line_no, concat('auth-bypass-', {number}) AS chain, concat('open route ', method, ' ', path, ' reaches ', gap) AS steps FROM {routes} r WHERE gap IS NOT NULL
      UNION ALL SELECT doc_id, CAST(NULL AS INT) AS line_no, 'cross-module-taint-main' AS chain, concat('input from outside reaches ', sinks, ' without a login') AS steps FROM {whole} w WHERE sinks <> ''"""


def semantic_findings(d: Dialect, files: str, routes: str, limit: int = 20) -> str:
    """Findings of routes and of chains: first all gaps, then chains up to a limit for a document."""
    gaps = f"SELECT doc_id, 1 AS part, CAST(line_no AS INT) AS line, 'high' AS severity, {d.num(0.82)} AS confidence, concat('Auth gap: ', path) AS title, concat(method, ' ', path, ' reaches ', gap, ' without a login') AS explanation FROM {routes} g WHERE gap IS NOT NULL"
    rest = f"SELECT doc_id, 2 AS part, CAST(NULL AS INT) AS line, 'high' AS severity, {d.num(0.7)} AS confidence, concat('Chain: ', chain) AS title, steps AS explanation FROM ({semantic_chains(d, files, routes)}) c"
    placed = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY part, line, title, explanation) AS place FROM ({gaps} UNION ALL {rest}) u)"
    return f"SELECT doc_id, CAST(place AS INT) AS place, line, severity, confidence, title, explanation FROM {placed} p WHERE part = 1 OR place <= {limit}"


def language_profiles(d: Dialect, files: str) -> str:
    """How many of its language's sources of input, and of its safe forms, a file has. Languages without a table have none."""
    of = lambda table: "CASE language " + " ".join(f"WHEN '{k}' THEN {d.count_of(d.match('code', p) for p in ps)}" for k, ps in table.items()) + " ELSE 0 END"
    return f"SELECT doc_id, language, CAST({of(V.LANGUAGE_SOURCES)} AS INT) AS n_sources, CAST({of(V.LANGUAGE_SAFE)} AS INT) AS n_safe FROM {_with_language(d, files)} n"


def languages(d: Dialect, files: str, hint: str = "'auto'") -> str:
    """The language that a hint names, or the one with the weightiest marks, at least 8; and the least review that its dangerous calls ask for."""
    full = "CASE language " + " ".join(f"WHEN '{k}' THEN {d.any('code', p)}" for k, p in V.ALWAYS_FULL.items()) + " ELSE FALSE END"
    return f"SELECT doc_id, language, {full} AS needs_full_review FROM {_with_language(d, files, hint)} r"


def _with_language(d: Dialect, files: str, hint: str = "'auto'") -> str:
    scores = {lang: (w, d.any("code", p)) for lang, w, p in V.LANGUAGE_MARKS}
    weights = sorted({w for w, _ in scores.values()}, reverse=True)
    guess = "CASE " + " ".join(f"WHEN {c} THEN '{lang}'" for w in weights for lang, (own, c) in scores.items() if own == w) + " ELSE 'unknown' END"
    named = d.lookup(d.replace(f"lower({hint})", "[^a-z#+-]", ""), V.LANGUAGE_HINTS, None)
    return f"(SELECT doc_id, code, COALESCE({named}, {guess}) AS language FROM {files} f)"


def assign_models(d: Dialect, tasks: str) -> str:
    """Model for each task, or its fallback where the first is not to be had. tasks: (id, task, available as a text with commas around each)."""
    of = lambda k: d.lookup("task", {t: m[k] for t, m in V.MODELS.items()})
    has = lambda x: f"{d.find('available', f'concat({d.text(chr(44))}, {x}, {d.text(chr(44))})')} > 0"
    first = d.extract("available", r",([^,]+),", 1)
    rows = f"(SELECT id, task, available, {of(0)} AS model_class, {of(1)} AS primary_model, {of(2)} AS fallback, {of(3)} AS cost FROM {tasks} t)"
    return f"SELECT id, task, model_class, CASE WHEN available = ',' OR {has('primary_model')} THEN primary_model WHEN {has('fallback')} THEN fallback ELSE {first} END AS model, cost AS cost_hundredths FROM {rows} r"


def client_keys(d: Dialect, requests: str) -> str:
    """The first forwarded address if it is one, else 'unknown'; and whether the request is of the same origin. requests: (id, forwarded, origin, host)."""
    raw = d.strip(d.extract("forwarded", r"^([^,]*)", 1))
    v4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z"
    octets = " AND ".join(f"CAST({d.extract('raw', v4, i)} AS INT) <= 255" for i in range(1, 5))
    ip = f"CASE WHEN {d.match('raw', v4)} THEN CASE WHEN {octets} THEN raw ELSE 'unknown' END WHEN {d.match('raw', '^[0-9a-f:]{2,39}' + chr(92) + 'z', 'i')} AND {d.find('raw', d.text(':'))} > 0 THEN raw ELSE 'unknown' END"
    host = d.extract("origin", r"^[a-z]+://([^/?#]+)", 1)
    return f"SELECT id, {ip} AS client, COALESCE(origin, '') = '' OR ({host} <> '' AND {host} = COALESCE(host, '')) AS same_origin FROM (SELECT *, COALESCE({raw}, '') AS raw FROM {requests} q) r"


def normalize_answers(d: Dialect, answers: str) -> str:
    """Findings of a model's answer, one JSON object a row, under fixed names and values; rows without a title go. answers: (doc_id, seq, body)."""
    j = lambda *keys: "COALESCE(" + ", ".join(d.json("body", k) for k in keys) + ", '')"
    rows = f"(SELECT doc_id, seq, lower({j('type')}) AS t, lower({j('severity')}) AS s, lower({j('category')}) AS c, {d.left(j('title', 'name'), 120)} AS title, {d.left(j('explanation', 'description'), 400)} AS explanation, {j('line')} AS line, {d.strip(j('fix'))} AS fix FROM {answers} a)"
    line = f"CASE WHEN {d.match('line', '^[0-9]+' + chr(92) + 'z')} THEN CAST(line AS INT) END"
    return f"""SELECT doc_id, seq, COALESCE({d.lookup('t', V.ISSUE_TYPES)}, 'risk') AS type, COALESCE({d.lookup('s', V.ISSUE_SEVERITIES)}, 'medium') AS severity,
      CASE WHEN c IN ('security', 'logic', 'performance', 'maintainability') THEN c ELSE 'security' END AS category, {line} AS line, title, explanation, NULLIF(fix, '') AS fix FROM {rows} r WHERE title <> ''"""
