"""A document seen as a system: middleware, guards, queries, events, wrappers, services, and paths from sources to sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import code_values as K
from ..functions.dialect import Dialect
from . import lines as L
from . import taint


def middleware(d: Dialect, lines: str) -> str:
    name = d.extract("raw", K.MIDDLEWARE, 2)
    return f"SELECT doc_id, line_no, name, {d.match('name', K.MIDDLEWARE_AUTH)} AS is_auth, {d.match('name', K.MIDDLEWARE_VALID)} AS is_validation, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS place FROM (SELECT doc_id, line_no, {name} AS name FROM {lines} l WHERE {d.match('raw', K.MIDDLEWARE)}) m"


def auth_checks(d: Dialect, lines: str) -> str:
    return f"SELECT doc_id, line_no, CASE WHEN {d.match('raw', K.AUTH_BYPASS)} THEN 'bypass-risk' ELSE 'check' END AS kind FROM {lines} l WHERE {d.match('raw', K.AUTH_CHECK)}"


def queries(d: Dialect, lines: str) -> str:
    kind = f"CASE WHEN {d.match('raw', K.QUERY_RAW)} THEN 'raw' WHEN {d.match('raw', K.QUERY_SAFE)} THEN 'safe' END"
    return f"SELECT doc_id, line_no, kind FROM (SELECT doc_id, line_no, {kind} AS kind FROM {lines} l) q WHERE kind IS NOT NULL"


def events(d: Dialect, lines: str) -> str:
    """Who sends an event joined to who takes it; the last line of each counts."""
    side = lambda p: f"(SELECT doc_id, event, MAX(line_no) AS line_no FROM (SELECT doc_id, line_no, {d.extract('raw', p, 1)} AS event FROM {lines} l WHERE {d.match('raw', p)}) e GROUP BY doc_id, event)"
    return f"SELECT p.doc_id, p.event, p.line_no AS producer, c.line_no AS consumer FROM {side(K.EMIT)} p JOIN {side(K.LISTEN)} c ON p.doc_id = c.doc_id AND p.event = c.event"


def wrappers(d: Dialect, lines: str) -> str:
    """Dangerous lines inside a function of the 15 lines before: the earliest one named there."""
    # a frame of lines before only; the first line has none
    before = d.near("raw", "doc_id", "line_no", 15, 0)
    rows = f"(SELECT doc_id, line_no, raw, trimmed, LAG(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS b14, {before} AS b FROM (SELECT *, {d.near('raw', 'doc_id', 'line_no', 14, 0)} AS b FROM {lines} l) x)"
    name = d.extract("b14", r"(?:function|const|async)\s+(\w+)\s*[=(]", 1)
    return f"SELECT doc_id, line_no, name, {d.match('name', 'validated|sanitized|escaped|safe', 'i')} AS safe FROM (SELECT doc_id, line_no, {name} AS name FROM {rows} r WHERE {d.match('raw', K.WRAPPED)} AND b14 IS NOT NULL) w WHERE name <> ''"


def services(d: Dialect, lines: str) -> str:
    rows = f"(SELECT *, {d.near('raw', 'doc_id', 'line_no', 5, 4)} AS around FROM {lines} l)"
    return f"SELECT doc_id, line_no, {d.match('around', K.SERVICE_AUTH, 'i')} AS authenticated FROM {rows} r WHERE {d.match('raw', K.SERVICE)}"


def findings(d: Dialect, lines: str) -> str:
    """What only the whole shows: handlers before any guard, hidden sinks, bypasses, raw queries without a guard near, calls without credentials."""
    first_auth = f"(SELECT doc_id, MIN(place) AS place FROM ({middleware(d, lines)}) a WHERE is_auth GROUP BY doc_id)"
    checks = f"(SELECT l.doc_id, l.line_no, MAX(CASE WHEN c.line_no IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY l.doc_id ORDER BY l.line_no ROWS BETWEEN 29 PRECEDING AND 29 FOLLOWING) AS guarded FROM {lines} l LEFT JOIN ({auth_checks(d, lines)}) c ON l.doc_id = c.doc_id AND l.line_no = c.line_no)"
    return f"""SELECT m.doc_id, m.line_no, 'unsafe-middleware-order' AS kind, 'high' AS severity FROM ({middleware(d, lines)}) m LEFT JOIN {first_auth} a ON m.doc_id = a.doc_id AND a.place < m.place WHERE NOT m.is_auth AND NOT m.is_validation AND m.place > 0 AND a.doc_id IS NULL
      UNION ALL SELECT doc_id, line_no, 'hidden-sink' AS kind, 'medium' AS severity FROM ({wrappers(d, lines)}) w WHERE NOT safe
      UNION ALL SELECT doc_id, line_no, 'auth-bypass-chain' AS kind, 'high' AS severity FROM ({auth_checks(d, lines)}) b WHERE kind = 'bypass-risk'
      UNION ALL SELECT q.doc_id, q.line_no, 'indirect-taint' AS kind, 'medium' AS severity FROM ({queries(d, lines)}) q JOIN {checks} c ON q.doc_id = c.doc_id AND q.line_no = c.line_no WHERE q.kind = 'raw' AND c.guarded = 0
      UNION ALL SELECT doc_id, line_no, 'privilege-escalation' AS kind, 'low' AS severity FROM ({services(d, lines)}) s WHERE NOT authenticated"""


def summary(d: Dialect, lines: str) -> str:
    """Counts per document of each part."""
    parts = {"middleware": middleware(d, lines), "auth_checks": auth_checks(d, lines), "queries": queries(d, lines), "events": events(d, lines), "wrappers": wrappers(d, lines), "services": services(d, lines), "findings": findings(d, lines)}
    rows = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS part FROM ({v}) {k}" for k, v in parts.items())
    return f"SELECT doc_id, {', '.join(f'''CAST(COUNT(CASE WHEN part = '{k}' THEN 1 END) AS BIGINT) AS {k}''' for k in parts)} FROM ({rows}) u GROUP BY doc_id"


def graph_nodes(d: Dialect, lines: str) -> str:
    """Sources, sinks, sanitizers, gates, services and bridges, one per kind and line: the first label; with a hash of the line."""
    parts = []
    for kind, table in K.GRAPH.items():
        label = d.first("raw", [(p, name) for p, name in table], None, "")
        parts.append(f"SELECT doc_id, line_no, '{kind}' AS kind, {label} AS label, {d.left(d.sha256('trimmed'), 16)} AS hash FROM {lines} l WHERE {d.any('raw', [p for p, _ in table])}")
    return " UNION ALL ".join(parts)


def changed_nodes(d: Dialect, lines: str, known: str) -> str:
    """Nodes that are new or whose line is not what it was. known: (doc_id, line_no, kind, hash)."""
    return f"SELECT n.* FROM ({graph_nodes(d, lines)}) n LEFT JOIN {known} k ON n.doc_id = k.doc_id AND n.line_no = k.line_no AND n.kind = k.kind AND n.hash = k.hash WHERE k.doc_id IS NULL"


def attack_paths(d: Dialect, lines: str) -> str:
    """From each source to the sinks after it, rated by a sanitizer or a gate in between.

    Running counts of both along the lines tell what lies between two of them without a join on it.
    """
    kinds = f"(SELECT doc_id, line_no, MAX(CASE WHEN kind = 'source' THEN 1 ELSE 0 END) AS src, MAX(CASE WHEN kind = 'sink' THEN 1 ELSE 0 END) AS snk, MAX(CASE WHEN kind = 'sanitizer' THEN 1 ELSE 0 END) AS san, MAX(CASE WHEN kind = 'auth-gate' THEN 1 ELSE 0 END) AS gate FROM ({graph_nodes(d, lines)}) g GROUP BY doc_id, line_no)"
    run = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    counted = f"(SELECT *, SUM(san) {run} AS n_san, SUM(gate) {run} AS n_gate FROM {kinds} k)"
    san, gate = "t.n_san - t.san - s.n_san > 0", "t.n_gate - t.gate - s.n_gate > 0"
    cvss = f"CASE WHEN {san} THEN 40 WHEN {gate} THEN 55 ELSE 85 END"
    return f"SELECT s.doc_id, s.line_no AS source_line, t.line_no AS sink_line, {san} AS has_sanitizer, {gate} AS has_gate, {cvss} AS cvss_tenths, CASE WHEN {cvss} >= 70 THEN 'high' ELSE 'medium' END AS severity FROM {counted} s JOIN {counted} t ON s.doc_id = t.doc_id AND t.line_no > s.line_no WHERE s.src = 1 AND t.snk = 1"


def _of_family(d: Dialect, text: str, family: str) -> str:
    return f"({d.find(text, d.text(family.replace('-', ' ')))} > 0 OR {d.find(text, d.text(family))} > 0)"


def chain_marks(d: Dialect) -> dict[str, str]:
    """Of which families of CHAIN_NEEDS a finding is, by its texts: 1 or 0 of each."""
    text = "lower(concat(title, ' ', explanation, ' ', category))"
    return {f"p{i}": f"CASE WHEN {_of_family(d, text, f)} THEN 1 ELSE 0 END" for i, (f, _, _) in enumerate(K.PRIMITIVES)}


def _chain_fits() -> list[tuple[int, int]]:
    return [(a, b) for a, (_, gives, _) in enumerate(K.PRIMITIVES) for b, (family, _, _) in enumerate(K.PRIMITIVES) if set(gives) & set(K.CHAIN_NEEDS.get(family, ()))]


def first_pairs(d: Dialect, marked: str) -> str:
    """A row per document: the first finding of each family that starts a chain, s, and the first later one of each that ends it, t. marked: findings with chain_marks()."""
    fits = _chain_fits()
    starts = sorted({a for a, _ in fits})
    first = f"(SELECT *, {', '.join(f'MIN(CASE WHEN p{a} = 1 THEN seq END) OVER (PARTITION BY doc_id) AS s{a}' for a in starts)} FROM {marked} n)"
    ends = ", ".join(f"MIN(CASE WHEN p{b} = 1 AND seq > s{a} THEN seq END) AS t{a}_{b}" for a, b in fits)
    return f"SELECT doc_id, {', '.join(f'MIN(s{a}) AS s{a}' for a in starts)}, {ends} FROM {first} f GROUP BY doc_id"


def chains_of_pairs(d: Dialect, met: str, issues: str) -> str:
    """two_step_chains() of the rows of first_pairs()."""
    arrow = " → "
    each = " UNION ALL ".join(f"SELECT doc_id, s{a} AS first_seq, t{a}_{b} AS second_seq, {d.text(K.PRIMITIVES[a][2] + arrow + K.PRIMITIVES[b][2])} AS title FROM {met} m{k} WHERE t{a}_{b} IS NOT NULL" for k, (a, b) in enumerate(_chain_fits()))
    sure = f"COALESCE(x.confidence, {d.num(0.7)}) + COALESCE(y.confidence, {d.num(0.7)})"
    return f"""SELECT c.doc_id, c.first_seq, c.second_seq, c.title, 'critical' AS severity, {d.half_up(f'({sure}) / {d.num(2.0)} * {d.num(70.0)}')} AS likelihood
      FROM ({each}) c JOIN {issues} x ON c.doc_id = x.doc_id AND c.first_seq = x.seq JOIN {issues} y ON c.doc_id = y.doc_id AND c.second_seq = y.seq"""


def two_step_chains(d: Dialect, issues: str) -> str:
    """Chains of two findings: the first gives what the second, later in the document, needs. Each pair of families is told once, by its first findings.

    The first of a family is a minimum over the document, so that no pairs of findings are made.
    """
    named = f"(SELECT doc_id, seq, confidence, {', '.join(f'{v} AS {k}' for k, v in chain_marks(d).items())} FROM {issues} i)"
    return chains_of_pairs(d, f"({first_pairs(d, named)})", issues)


def chains(d: Dialect, issues: str) -> str:
    """Attack chains of a document: what its findings provide, which escalations that allows, and findings that reach one. Five at most, a title once."""
    text = "lower(concat(title, ' ', explanation, ' ', category))"
    prims = [(i, _of_family(d, text, family), provides, label) for i, (family, provides, label) in enumerate(K.PRIMITIVES)]
    named = f"(SELECT doc_id, seq, confidence, {', '.join(f'CASE WHEN {h} THEN 1 ELSE 0 END AS p{i}' for i, h, _, _ in prims)} FROM {issues} i)"
    caps = sorted({c for _, _, ps, _ in prims for c in ps})
    col = {c: f"c_{c.replace('-', '_')}" for c in caps}
    have = ", ".join("MAX(GREATEST(" + ", ".join([f"p{i}" for i, _, ps, _ in prims if c in ps] + ["0"]) + f")) AS {col[c]}" for c in caps)
    per_doc = f"(SELECT doc_id, {have} FROM {named} n GROUP BY doc_id)"
    # escalations in order: a later one may need an earlier one
    made: dict[str, str] = {}
    for requires, enables in K.ESCALATIONS:
        made[enables] = "(" + " AND ".join(made[r] if r in made else f"{col[r]} = 1" if r in col else "FALSE" for r in requires) + ")"
    reached = f"(SELECT doc_id, {', '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END AS e{k}' for k, c in enumerate(made.values()))} FROM {per_doc} x)"
    out = []
    for i, _, provides, label in prims:
        if not {"rce", "admin-access", "credential-dump"} & set(provides):
            continue
        fits = [k for k, e in enumerate(made) if any(c.replace("-", " ") in e.lower() for c in provides)]
        some = "(" + " OR ".join([f"e{k} = 1" for k in fits] + (["TRUE"] if "rce" in provides else [])) + ")" if fits or "rce" in provides else "FALSE"
        critical = "TRUE" if "rce" in provides else "(" + " OR ".join([f"e{k} = 1" for k in fits if "takeover" in list(made)[k]] or ["FALSE"]) + ")"
        likely = d.half_up(f"COALESCE(confidence, {d.num(0.7)}) * 70")
        out.append(f"SELECT n.doc_id, n.seq, {i} AS prim, {d.text(label)} AS title, CASE WHEN {critical} THEN 'critical' ELSE 'high' END AS severity, {likely} AS likelihood FROM {named} n JOIN {reached} r ON n.doc_id = r.doc_id WHERE p{i} = 1 AND {some}")
    first = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, title ORDER BY seq, prim) AS copy FROM ({' UNION ALL '.join(out)}) u)"
    placed = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY CASE severity WHEN 'critical' THEN 0 ELSE 1 END, seq, prim) AS place FROM {first} f WHERE copy = 1)"
    return f"SELECT doc_id, CAST(place AS INT) AS place, seq, title, severity, likelihood FROM {placed} p WHERE place <= 5"


def call_starts(d: Dialect, lines: str) -> str:
    """Functions that call others and that none calls."""
    steps = f"({call_steps(d, lines)})"
    return f"SELECT DISTINCT a.doc_id, a.src AS node FROM {steps} a LEFT JOIN (SELECT DISTINCT doc_id, dst FROM {steps} x) b ON a.doc_id = b.doc_id AND a.src = b.dst WHERE b.dst IS NULL"


def call_steps(d: Dialect, lines: str) -> str:
    return f"SELECT DISTINCT doc_id, caller AS src, callee AS dst FROM ({L.calls(d, lines)}) c WHERE caller <> callee"


def downstream(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """(doc_id, node, hops): what is reached from the starts, (doc_id, node), over steps, (doc_id, src, dst), however far; with the fewest steps to it. Starts themselves are left out."""
    zero = "CAST(0 AS INT) AS line_no"
    return taint.closure(starts.selectExpr("doc_id", "node AS var", zero), steps.selectExpr("doc_id", "src", "dst", zero), 2**31 - 1).where("hops > 0").selectExpr("doc_id", "var AS node", "hops")


def downstream_sql(d: Dialect, starts: str, steps: str, far: int = 64) -> str:
    """The same as a recursive query, so many steps far at most."""
    return f"""WITH RECURSIVE st AS MATERIALIZED (SELECT * FROM {steps} z), walk AS (SELECT doc_id, node, 0 AS hops FROM {starts} s
      UNION SELECT w.doc_id, e.dst, w.hops + 1 FROM walk w JOIN st e ON w.doc_id = e.doc_id AND w.node = e.src WHERE w.hops < {far}) SELECT doc_id, node, CAST(MIN(hops) AS INT) AS hops FROM walk v GROUP BY doc_id, node HAVING MIN(hops) > 0"""
