"""Data-flow findings: tainted names at sinks, in pages and in outgoing requests, and what frameworks leave open.

`tainted` is (doc_id, var, pass_no, line_no, hops) of tainted(). A name is on a line if the line has it as a word, or as two words with a dot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import code_values as K
from ..functions import flow_values as V
from ..functions import rule_values as R
from ..functions.dialect import Dialect
from ..functions.run import apply
from . import classify as C
from . import lines as L
from . import taint


def flagged(d: Dialect, lines: str) -> str:
    """Lines with `dead`: whether they can never run."""
    return f"SELECT l.*, x.line_no IS NOT NULL AS dead FROM {lines} l LEFT JOIN ({L.dead(d, lines)}) x ON l.doc_id = x.doc_id AND l.line_no = x.line_no"


def _live(lines: str) -> str:
    return f"(SELECT * FROM {lines} lv WHERE NOT dead)"


def seeds(d: Dialect, lines: str) -> str:
    """Sources on lines that can run."""
    return taint.seeds(d, _live(lines))


def edges(d: Dialect, lines: str) -> str:
    """(doc_id, src, dst, line_no) on lines that can run: plain, read, unpacked and computed values, fields, callbacks, calls, and constructors that keep an argument in a field.

    A line that sanitizes what it assigns hands nothing on. All assignments of a line come from one look at it; a name with a dot stands for itself and for what it begins with.
    """
    x = lambda p, g: d.extract("raw", p, g)
    part = lambda target, source, cond: f"CASE WHEN {cond} THEN {d.each(d.any_word(source), 'w', f'concat({target}, {d.text(chr(32))}, w)')} ELSE {d.array([])} END"
    m = lambda p: d.match("raw", p)
    target, rest = x(V.FLOW_TARGET, 1), x(V.FLOW_TARGET, 2)
    made = [
        part(x(V.FLOW_ASSIGN, 1), x(V.FLOW_ASSIGN, 2), m(V.FLOW_ASSIGN)),
        part(x(V.FLOW_READ, 1), x(V.FLOW_READ, 2), f"{m(V.FLOW_READ)} AND {d.find(x(V.FLOW_READ, 2), d.text('.'))} > 0"),
        *(part(x(p, 1), x(p, 2), m(p)) for p in R.ALIASES[1:]),
        part(target, rest, f"{m(V.FLOW_TARGET)}"),
        part(x(V.FLOW_CALLBACK, 2), x(V.FLOW_CALLBACK, 1), m(V.FLOW_CALLBACK)),
    ]
    some = d.any("raw", [V.FLOW_ASSIGN, V.FLOW_READ, *R.ALIASES[1:], V.FLOW_TARGET, V.FLOW_CALLBACK])
    live = _live(lines)
    clean = f"{L.sanitizers(d, 'raw')} = ''"
    each = d.explode(f"(SELECT doc_id, line_no, flatten({d.array(made)}) AS pairs FROM {live} l WHERE {some} AND {clean}) s", "pairs", "pair", "pos", "doc_id, line_no")
    plain = f"SELECT doc_id, line_no, {d.extract('pair', '^([^ ]+) (.+)', 2)} AS src, {d.extract('pair', '^([^ ]+) (.+)', 1)} AS dst FROM {each} e"
    split = lambda t: f"split({t}, ',')" if d.name == "spark" else f"string_split({t}, ',')"
    unpacked = d.explode(f"(SELECT doc_id, line_no, {x(V.FLOW_UNPACK, 2)} AS src, {split(x(V.FLOW_UNPACK, 1))} AS names FROM {live} l WHERE {m(V.FLOW_UNPACK)}) s", "names", "part", "pos", "doc_id, line_no, src")
    unpack = f"SELECT doc_id, line_no, src, {d.strip(d.replace('part', '[=:].*', ''))} AS dst FROM {unpacked} u"
    args = d.explode(f"(SELECT doc_id, line_no, {x(V.FLOW_MADE, 1)} AS dst, {x(V.FLOW_MADE, 2)} AS callee, {split(x(V.FLOW_MADE, 3))} AS args FROM {live} l WHERE {m(V.FLOW_MADE)}) s", "args", "arg", "pos", "doc_id, line_no, dst, callee")
    kept = f"SELECT a.doc_id, a.line_no, {d.strip('a.arg')} AS src, concat(a.dst, '.', f.field) AS dst FROM {args} a JOIN ({constructor_fields(d, lines)}) f ON a.doc_id = f.doc_id AND a.callee = f.class_name AND a.pos = f.place"
    called = f"SELECT doc_id, line_no, src, dst FROM ({taint.calls(d, live, clean)}) c"
    return f"SELECT DISTINCT doc_id, src, dst, line_no FROM ({plain} UNION ALL {unpack} UNION ALL {kept} UNION ALL {called}) u WHERE src <> dst AND src <> '' AND dst <> ''"


def tainted(lines: DataFrame) -> DataFrame:
    """(doc_id, var, pass_no, line_no, hops) over flagged lines."""
    return taint.closure(apply(seeds, lines=lines), apply(edges, lines=lines))


def tainted_sql(d: Dialect, lines: str) -> str:
    """The same as a recursive query."""
    return taint.hops_sql(d, seeds(d, lines), edges(d, lines))


def on_lines(d: Dialect, lines: str, tainted: str) -> str:
    """(doc_id, line_no, var): tainted names among the words of each line, by equality on the words."""
    each = d.explode(f"(SELECT doc_id, line_no, {d.any_word('raw')} AS words FROM {lines} l) s", "words", "word", "pos", "doc_id, line_no")
    return f"SELECT DISTINCT w.doc_id, w.line_no, t.var, t.hops, t.line_no AS source_line FROM {each} w JOIN {tainted} t ON w.doc_id = t.doc_id AND w.word = t.var"


def _guards(d: Dialect, lines: str, hot: str) -> str:
    """The rows of hot, (doc_id, line_no, var) and more, with the guards in force on the line and those about the name: running sums of steps where guards begin and end."""
    steps = f"(SELECT doc_id, variable, line_no + 1 AS line_no, 1 AS step FROM ({L.path_facts(d, lines)}) a UNION ALL SELECT doc_id, variable, protects_until + 1 AS line_no, -1 AS step FROM ({L.path_facts(d, lines)}) b)"
    keys = f"(SELECT doc_id, line_no, COALESCE(variable, '') AS var, step, 0 AS asks FROM {steps} s)"
    asked = f"(SELECT DISTINCT doc_id, line_no, var, 0 AS step, 1 AS asks FROM {hot} h)"
    both = f"(SELECT * FROM {keys} k UNION ALL SELECT * FROM {asked} q)"
    frame = "ORDER BY line_no, asks ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sums = f"(SELECT *, SUM(step) OVER (PARTITION BY doc_id {frame}) AS n_guards, SUM(step) OVER (PARTITION BY doc_id, var {frame}) AS n_own FROM {both} u)"
    return f"(SELECT h.*, g.n_guards, g.n_own FROM {hot} h JOIN (SELECT * FROM {sums} x WHERE asks = 1) g ON h.doc_id = g.doc_id AND h.line_no = g.line_no AND h.var = g.var)"


def sink_findings(d: Dialect, lines: str, tainted: str) -> str:
    """Tainted names at the first sink of a line that can run, those in its argument if any, unless what stands around covers the sink. lines: flagged().

    A request goes out even if covered, and counts less then. A child process that gets a list of arguments and no shell is open to options only: a class of its own.
    """
    sink = d.first("raw", [(p, k, "") for k, p in V.SINKS], None, "")
    rows = f"(SELECT doc_id, line_no, raw, dead, {sink} AS sink, {d.near('raw', 'doc_id', 'line_no', 5, 2)} AS around FROM {lines} l)"
    argument = "CASE sink " + " ".join(f"WHEN '{k}' THEN {d.extract('raw', p, 1)}" for k, p in V.SINK_ARGUMENTS.items()) + " END"
    words = f"(SELECT doc_id, line_no, sink, around, {d.any_word(argument)} AS args FROM {rows} r WHERE sink IS NOT NULL AND NOT dead)"
    met = f"(SELECT r.doc_id, r.line_no, r.sink, {L.sanitizers(d, 'r.around')} AS kinds, {d.match('r.around', V.ARGUMENT_LIST)} AND NOT {d.match('r.around', V.WITH_SHELL)} AS listed, t.var, t.hops, CASE WHEN {d.has('r.args', 't.var')} THEN 1 ELSE 0 END AS given FROM {words} r JOIN ({on_lines(d, _live(lines), tainted)}) t ON r.doc_id = t.doc_id AND r.line_no = t.line_no WHERE t.source_line <> r.line_no)"
    hot = f"(SELECT doc_id, line_no, sink, kinds, listed, var, hops FROM (SELECT *, MAX(given) OVER (PARTITION BY doc_id, line_no) AS best FROM {met} m) c WHERE given = best)"
    has = lambda k: f"{d.find('concat(' + d.text(',') + ', kinds, ' + d.text(',') + ')', d.text(f',{k},'))} > 0"
    own = "CASE sink " + " ".join(f"WHEN '{s}' THEN {has(k)}" for s, k in V.COVERS.items()) + " ELSE FALSE END"
    covered = f"({has('schema')} OR {has('allowlist')} OR n_own > 0 OR {own})"
    base = d.lookup("sink", {k: v[1] for k, v in V.SINK_FACTS.items()}, 70)
    told = f"(SELECT *, {covered} AS covered, LEAST(3, n_guards) AS conds FROM {_guards(d, lines, hot)} g)"
    split = f"(SELECT *, sink = 'cmd' AND covered AND listed AS options FROM {told} t)"
    scored = f"""(SELECT *, CASE WHEN options THEN GREATEST(45, 90 - hops * 8) ELSE GREATEST(45, 95 - hops * 8 - conds * 5) END AS reachability, CASE WHEN options THEN 45 ELSE GREATEST(35, {base} - CASE WHEN kinds <> '' THEN 35 ELSE 0 END - conds * 4) END AS exploitability,
      CASE WHEN options THEN 62 ELSE GREATEST(45, LEAST(96, 85 - hops * 4 - CASE WHEN kinds <> '' THEN 25 ELSE 0 END)) END AS confidence FROM {split} t WHERE NOT covered OR options OR sink = 'ssrf')"""
    listed = lambda xs: ", ".join(d.text(x) for x in xs)
    severity = f"CASE WHEN options THEN 'medium' WHEN sink IN ({listed(V.SEVERE)}) THEN 'high' ELSE 'medium' END"
    blast = f"CASE WHEN options THEN 'medium' WHEN sink IN ({listed(V.CRITICAL)}) THEN 'critical' WHEN sink IN ({listed(V.SEVERE)}) THEN 'high' ELSE 'medium' END"
    cwe = f"CASE WHEN options THEN 'CWE-88' ELSE {d.lookup('sink', {k: v[0] for k, v in V.SINK_FACTS.items()})} END"
    advice = f"{d.lookup('sink', V.SINK_PAYLOADS)} AS payload, {d.lookup('sink', V.SINK_IMPACTS, 'scripts in pages')} AS impact, {d.lookup('sink', V.SINK_FIXES, 'encode for the context')} AS fix"
    return f"SELECT doc_id, CAST(line_no AS INT) AS line_no, sink, var, {cwe} AS cwe, {severity} AS severity, {blast} AS blast_radius, CAST(reachability AS INT) AS reachability, CAST(exploitability AS INT) AS exploitability, CAST(confidence AS INT) AS confidence, {advice} FROM {scored} s"


def score_flow(d: Dialect, findings: str) -> str:
    """Scores adjusted by weakness class, and one risk of them. findings: (doc_id, line_no, sink, var, cwe, blast_radius, reachability, exploitability, confidence)."""
    n = d.num
    e = "CASE WHEN cwe = 'CWE-78' THEN GREATEST(exploitability, 92) WHEN cwe = 'CWE-88' THEN LEAST(exploitability, 58) WHEN cwe = 'CWE-862' THEN GREATEST(exploitability, 76) WHEN cwe = 'CWE-601' THEN LEAST(GREATEST(exploitability, 60), 72) ELSE exploitability END"
    r = "CASE WHEN cwe = 'CWE-862' THEN GREATEST(reachability, 90) ELSE reachability END"
    c = "CASE WHEN sink = 'ssrf' THEN LEAST(confidence + 5, 95) ELSE confidence END"
    b = "CASE WHEN cwe = 'CWE-78' THEN 'critical' WHEN cwe = 'CWE-88' AND blast_radius = 'critical' THEN 'high' WHEN cwe = 'CWE-601' AND blast_radius = 'critical' THEN 'medium' ELSE blast_radius END"
    rows = f"(SELECT doc_id, line_no, sink, var, cwe, {e} AS exploitability, {r} AS reachability, {c} AS confidence, {b} AS blast_radius FROM {findings} f)"
    mult = d.lookup("blast_radius", {"critical": 1.0, "high": 0.85, "medium": 0.65, "low": 0.45}, 0.45)
    risk = d.half_up(f"(exploitability * {n(0.4)} + reachability * {n(0.4)} + confidence * {n(0.2)}) * {mult}")
    return f"SELECT doc_id, line_no, sink, var, cwe, exploitability, reachability, confidence, blast_radius, {risk} AS risk FROM {rows} x"


def page_findings(d: Dialect, lines: str, tainted: str) -> str:
    """Tainted values written into pages, one finding a line, with the context that tells how to encode them. lines: flagged()."""
    dom, tmpl, jsx, part = (d.strip(d.extract("raw", p, 1)) for p in (V.DOM_VALUE, V.MARKUP_VALUE, V.JSX_VALUE, V.ANY_VALUE))
    rows = f"(SELECT doc_id, line_no, raw, {dom} AS dom, {tmpl} AS tmpl, CASE WHEN {d.match('raw', 'dangerouslySetInnerHTML')} THEN {jsx} ELSE '' END AS jsx, {part} AS part FROM {_live(lines)} l)"
    hot = f"(SELECT r.*, t.var FROM {rows} r JOIN ({on_lines(d, _live(lines), tainted)}) t ON r.doc_id = t.doc_id AND r.line_no = t.line_no)"
    head = f"{d.left('raw', 'GREATEST(0, ' + d.find('raw', 'COALESCE(NULLIF(tmpl, ' + d.text('') + '), dom)') + ' - 1)')}"
    context = f"CASE {' '.join(f'WHEN {d.match(head, p)} THEN {d.text(k)}' for p, k in V.XSS_BEFORE)} {' '.join(f'WHEN {d.match('raw', p)} THEN {d.text(k)}' for p, k in V.XSS_LINE)} ELSE 'html-body' END"
    base = d.extract("tmpl", r"^([^.]*)", 1)
    safe = lambda x: f"({x} <> '' AND {d.match(x, V.HTML_SAFE)})"
    kind = f"""CASE WHEN {safe('dom')} THEN NULL WHEN dom <> '' AND {d.find('dom', 'var')} > 0 THEN {context} WHEN {safe('tmpl')} THEN NULL WHEN tmpl <> '' AND (tmpl = var OR {base} = var) THEN {context}
      WHEN jsx <> '' AND NOT {safe('jsx')} AND {d.find('jsx', 'var')} > 0 THEN 'jsx' WHEN {d.match('raw', r'\beval\s*\(')} OR {d.match('raw', r'setTimeout\s*\(\s*\w+\s*,')} THEN 'inline-js'
      WHEN part = var AND {d.match('raw', r'style\s*=')} THEN 'css' WHEN part = var AND {d.match('raw', r'href\s*=\s*`|src\s*=\s*`')} AND NOT {d.match('raw', V.URL_SAFE)} THEN 'url' END"""
    ranked = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, line_no ORDER BY context, var) AS place FROM (SELECT doc_id, line_no, var, {kind} AS context FROM {hot} h) k WHERE context IS NOT NULL)"
    return f"SELECT doc_id, CAST(line_no AS INT) AS line_no, var, context, CASE WHEN context = 'inline-js' THEN 95 ELSE 90 END AS exploitability, {d.lookup('context', V.XSS_PAYLOADS)} AS payload FROM {ranked} r WHERE place = 1"


def request_findings(d: Dialect, lines: str, tainted: str) -> str:
    """Outgoing requests to a tainted address, without an allowlist in the lines around; and whether the line has an address in another number system. lines: flagged()."""
    call, tmpl = d.extract("raw", V.REQUEST_TO, 1), d.extract("raw", V.REQUEST_BUILT, 1)
    odd = d.any("raw", V.ODD_ADDRESSES)
    rows = f"(SELECT doc_id, line_no, dead, {call} AS direct, {tmpl} AS built, {odd} AS odd_address, {d.near('raw', 'doc_id', 'line_no', 5, 1)} AS around FROM {lines} l)"
    part = lambda col, kind, conf: f"SELECT r.doc_id, CAST(r.line_no AS INT) AS line_no, r.{col} AS var, '{kind}' AS kind, {conf} AS confidence, r.odd_address FROM {rows} r JOIN {tainted} t ON r.doc_id = t.doc_id AND r.{col} = t.var WHERE NOT r.dead AND NOT {d.match('r.around', V.REDIRECT_SAFE, 'i')}"
    return f"{part('direct', 'direct', 90)} UNION ALL {part('built', 'template', 80)}"


def framework_findings(d: Dialect, lines: str, files: str) -> str:
    """Sensitive routes without a guard, tokens decoded for decisions, resolvers with raw queries, messages without a schema."""
    flags = f"(SELECT doc_id, {d.find(C.file_frameworks(d), d.text('GraphQL'))} > 0 AS graphql, {d.match('code', r'WebSocket|ws\.on|socket\.on|io\.on')} AS sockets FROM {files} f)"
    rows = f"(SELECT l.doc_id, l.line_no, l.raw, f.graphql, f.sockets, {d.near('l.raw', 'l.doc_id', 'l.line_no', 0, 4)} AS next5, {d.near('l.raw', 'l.doc_id', 'l.line_no', 0, 9)} AS next10, {d.near('l.raw', 'l.doc_id', 'l.line_no', 0, 14)} AS next15 FROM {lines} l JOIN {flags} f ON l.doc_id = f.doc_id)"
    jwt = f"{d.match('raw', r'jwt\.decode\s*\(')} AND {d.match('next5', r'user\.|role|admin|auth|permission', 'i')}"
    gql = f"graphql AND {d.match('raw', r'resolve[r]?\s*[\(:,]')} AND {d.match('next15', r'args\.\w+')} AND {d.match('next15', r'db\.|query\(')} AND NOT {d.match('next15', V.PARAMETERIZED, 'i')}"
    ws = f"sockets AND {d.match('raw', r'''(?:socket|ws)\.on\s*\(\s*['\"]message['\"]''')} AND {d.match('next10', r'JSON\.parse|data\.')} AND NOT {d.match('next10', 'zod|joi|yup|validate|schema', 'i')}"
    found = [("jwt-decode-auth", "high", jwt), ("graphql-resolver-sqli", "high", gql), ("websocket-unvalidated", "medium", ws)]
    parts = [f"SELECT doc_id, CAST(line_no AS INT) AS line_no, '{k}' AS kind, '{s}' AS severity FROM {rows} r{i} WHERE {c}" for i, (k, s, c) in enumerate(found)]
    routes = f"SELECT doc_id, CAST(line_no AS INT) AS line_no, 'missing-auth' AS kind, 'high' AS severity FROM ({L.routes(d, lines)}) x WHERE sensitive AND NOT auth_guard"
    return " UNION ALL ".join([routes, *parts])


def trust_boundaries(d: Dialect, lines: str, files: str) -> str:
    """Of each file: names that take outside input, and the kinds of sanitizer that it has."""
    js = r"(?:const|let|var)\s+(?:\{([^}]+)\}|(\w+))\s*=\s*(?:req\.|request\.|ctx\.|event\.)\s*(?:query|params|body|headers)"
    form = r"(?:const|let|var)\s+(\w+)\s*=\s*(?:formData|searchParams)\.get\s*\("
    py = r"^\s*(\w+)\s*=\s*(?:request\.(?:args|form|json|files|values|GET|POST|query_params|path_params)\.get|await\s+request\.json|request\.get_json)\s*\("
    names = d.join([d.extract("raw", js, 1), d.extract("raw", js, 2), d.extract("raw", form, 1), d.extract("raw", py, 1)], " ")
    each = d.explode(f"(SELECT doc_id, line_no, {d.extract_all(names, r'\w+')} AS words FROM {lines} l WHERE {d.any('raw', [js, form, py])}) s", "words", "word", "pos", "doc_id, line_no")
    first = f"(SELECT doc_id, word, MIN(line_no * 1000 + pos) AS place FROM {each} e GROUP BY doc_id, word)"
    listed = f"(SELECT doc_id, {d.collect('word', ['place', 'word'])} AS untrusted FROM {first} f GROUP BY doc_id)"
    return f"SELECT f.doc_id, COALESCE(u.untrusted, '') AS untrusted, {L.sanitizers(d, 'f.code')} AS sanitizers FROM {files} f LEFT JOIN {listed} u ON f.doc_id = u.doc_id"


def constructor_fields(d: Dialect, lines: str) -> str:
    """(doc_id, class_name, field, param, place): constructor parameters kept in fields, by the nearest class and constructor before the assignment; place is from 1, self left out."""
    cls, init = d.extract("raw", K.CLASS, 1), d.extract("raw", r"^\s*def\s+__init__\s*\(([^)]*)\)\s*:", 1)
    deff = d.match("raw", r"^\s*(?:async\s+)?def\s")
    rows = f"(SELECT doc_id, line_no, raw, NULLIF({cls}, '') AS cls, CASE WHEN {deff} THEN {init} END AS init FROM {lines} l)"
    params = d.replace(d.last_known("init", "doc_id", "line_no"), r"^\s*self\s*,?\s*", "")
    known = f"(SELECT doc_id, line_no, raw, {d.last_known('cls', 'doc_id', 'line_no')} AS class_name, {params} AS params FROM {rows} r)"
    field, param = d.extract("raw", r"self\.(\w+)\s*=\s*(\w+)", 1), d.extract("raw", r"self\.(\w+)\s*=\s*(\w+)", 2)
    split = "split" if d.name == "spark" else "string_split"
    each = d.explode(f"(SELECT doc_id, line_no, class_name, {field} AS field, {param} AS param, {split}(params, ',') AS list FROM {known} k WHERE class_name IS NOT NULL AND COALESCE(params, '') <> '' AND {field} <> '') s", "list", "part", "pos", "doc_id, line_no, class_name, field, param")
    clean = d.strip(d.replace("part", "[=:].*", ""))
    return f"SELECT doc_id, CAST(line_no AS INT) AS line_no, class_name, field, param, CAST(pos AS INT) AS place FROM {each} e WHERE {clean} = param"


def audit(d: Dialect, issues: str, scores: str) -> str:
    """Whether a result may be trusted: no vague severe finding, and a score that its findings bear out within 15. scores: (doc_id, reported)."""
    penalty = "CASE WHEN type = 'suggestion' THEN 2 WHEN severity = 'high' THEN CASE WHEN type = 'bug' THEN 20 ELSE 12 END WHEN severity = 'medium' THEN CASE WHEN type = 'bug' THEN 10 ELSE 6 END WHEN type = 'bug' THEN 4 ELSE 3 END"
    vague = "COUNT(CASE WHEN severity = 'high' AND length(explanation) < 60 THEN 1 END)"
    silent = f"COUNT(CASE WHEN type = 'bug' AND fix IS NULL AND COALESCE(fix_rejection_reason, '') = '' AND NOT {d.match('explanation', 'cannot safely auto.fix|architectural|remove dynamic|no safe fix|forbidden|unsafe', 'i')} THEN 1 END)"
    rows = f"(SELECT doc_id, CAST({vague} AS BIGINT) AS vague, CAST({silent} AS BIGINT) AS undocumented, CAST(GREATEST(0, 100 - SUM({penalty})) AS BIGINT) AS computed FROM {issues} i GROUP BY doc_id)"
    return f"SELECT r.doc_id, r.vague, r.undocumented, r.computed, ABS(s.reported - r.computed) > 15 AS drifted, r.vague = 0 AND ABS(s.reported - r.computed) <= 15 AS passed FROM {rows} r JOIN {scores} s ON r.doc_id = s.doc_id"


def compact(d: Dialect, issues: str) -> str:
    """Findings of a document as the short text that reviewers get."""
    opt = lambda label, col, n: f"CASE WHEN COALESCE({col}, '') <> '' THEN concat('{label}: ', {d.left(col, n)}) END"
    head = "concat('[', CAST(place - 1 AS VARCHAR(10)), '] ', upper(severity), ' ', type, ' L', COALESCE(CAST(line AS VARCHAR(12)), '?'), ': ', title)"
    line = d.join([head, f"concat('EXPLAIN: ', {d.left('explanation', 200)})", opt("CHAIN", "exploit_chain", 120), opt("PAYLOAD", "exploit_payload", 80), opt("FIX", "fix", 100)], " | ")
    return f"SELECT doc_id, {d.collect('told', 'seq', chr(10))} AS told FROM (SELECT doc_id, seq, {line} AS told FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM {issues} i) x) y GROUP BY doc_id"
