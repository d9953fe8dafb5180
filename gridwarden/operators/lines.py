"""Source text as lines, and what a line or its neighbourhood says: definitions, calls, flow, versions, guards, dead code.

A document's lines are ordered by line_no; every frame is over them, so one exchange by document serves a whole chain.
"""

from __future__ import annotations

from ..functions import code_values as K
from ..functions.dialect import Dialect

W = "PARTITION BY doc_id ORDER BY line_no"


def marked(d: Dialect, files: str) -> str:
    """Lines of each file by themselves: number from 1, raw and trimmed text, indent, comment and string flags, and the file that a marker on the line names."""
    split = d.explode(f"(SELECT doc_id, {d.lines('code')} AS all_lines FROM {files} f) s", "all_lines", "raw", "line_no", "doc_id")
    trimmed = f"(SELECT doc_id, line_no, raw, {d.strip('raw')} AS trimmed, length({d.extract('raw', r'^\s*')}) AS indent FROM {split} x)"
    marks = [f"NULLIF({d.strip(d.extract('trimmed', p, 1, 'i'))}, '')" for p in K.FILE_MARKERS]
    starts = f"({d.left('trimmed', 2)} = '//' OR {d.left('trimmed', 1)} = '*' OR {d.left('trimmed', 2)} = '/*')"
    quoted = d.left("trimmed", 1) + """ IN ('"', '`', '''')""" if d.name == "duck" else d.left("trimmed", 1) + """ IN ('"', '`', '\\'')"""
    return f"SELECT doc_id, line_no, raw, trimmed, indent, {starts} AS is_comment, {quoted} AS is_string, COALESCE({', '.join(marks)}) AS mark FROM {trimmed} t"


def parse(d: Dialect, files: str) -> str:
    """marked(), with the file that the last marker named."""
    return f"SELECT doc_id, line_no, raw, trimmed, indent, is_comment, is_string, COALESCE({d.last_known('mark', 'doc_id', 'line_no')}, '<input>') AS file FROM ({marked(d, files)}) m"


def stats(d: Dialect, lines: str) -> str:
    n = lambda c: f"CAST(COUNT(CASE WHEN {c} THEN 1 END) AS BIGINT)"
    return f"SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_lines, {n('trimmed = ' + d.text(''))} AS blank, {n('is_comment')} AS comments, {n('is_string')} AS strings, CAST(MAX(indent) AS INT) AS max_indent, CAST(COUNT(DISTINCT file) AS BIGINT) AS files FROM {lines} l GROUP BY doc_id"


def _definition(d: Dialect, group: int) -> str:
    """A group of the first definition pattern that a line has."""
    return "CASE " + " ".join(f"WHEN {d.match('raw', p)} THEN " + (d.extract("raw", p, group) if group <= g else d.text("")) for p, g in K.DEFINITIONS) + " END"


def nodes(d: Dialect, lines: str) -> str:
    """Functions and classes by name; the last definition of a name counts."""
    kind = "CASE " + " ".join(f"WHEN {d.match('raw', p)} THEN '{k}'" for (p, _), k in zip(K.DEFINITIONS, ("function", "arrow", "def", "class"), strict=True)) + " END"
    found = f"(SELECT doc_id, line_no, file, raw, {_definition(d, 1)} AS name, {_definition(d, 2)} AS params, {kind} AS kind FROM {lines} l)"
    is_async = f"CASE kind WHEN 'def' THEN {d.match('raw', 'async\\s+def')} WHEN 'class' THEN FALSE ELSE {d.match('raw', 'async')} END"
    ranked = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, name ORDER BY line_no DESC) AS place FROM {found} f WHERE kind IS NOT NULL)"
    return f"SELECT doc_id, name, line_no, kind, {d.strip('params')} AS params, {is_async} AS is_async, file FROM {ranked} r WHERE place = 1"


def enclosing(d: Dialect, lines: str, other: str = "__global__") -> str:
    """Each line with the definition that it stands in or after: the nearest one before it."""
    return f"SELECT l.*, COALESCE({d.last_known('n.name', 'l.doc_id', 'l.line_no')}, '{other}') AS fn FROM {lines} l LEFT JOIN ({nodes(d, lines)}) n ON l.doc_id = n.doc_id AND l.line_no = n.line_no"


def calls(d: Dialect, lines: str) -> str:
    """Calls of functions that the document defines, with the caller; `across` where they cross files."""
    each = d.explode(f"(SELECT doc_id, line_no, fn, file, {d.extract_all('raw', K.CALL)} AS found FROM ({enclosing(d, lines)}) e) s", "found", "call", "pos", "doc_id, line_no, fn, file")
    named = f"(SELECT doc_id, line_no, fn, file, pos, {d.extract('call', K.CALL, 1)} AS callee, {d.strip(d.extract('call', K.CALL, 2))} AS args FROM {each} c)"
    return f"SELECT c.doc_id, c.line_no, CAST(c.pos AS INT) AS pos, c.fn AS caller, c.callee, c.args, c.file <> n.file AS across FROM {named} c JOIN ({nodes(d, lines)}) n ON c.doc_id = n.doc_id AND c.callee = n.name"


def flow_nodes(d: Dialect, lines: str) -> str:
    kind = f"CASE WHEN {d.match('raw', K.BRANCH)} THEN 'branch' WHEN {d.match('raw', r'\breturn\b')} THEN 'return' WHEN {d.match('raw', r'\bthrow\b|raise\s+')} THEN 'throw' WHEN {d.match('raw', K.SINK_LINE)} THEN 'sink' ELSE 'statement' END"
    return f"SELECT doc_id, line_no, indent, trimmed, {kind} AS kind, fn FROM ({enclosing(d, lines)}) e WHERE trimmed <> '' AND NOT is_comment"


def _ends(d: Dialect, starts: str, rows: str, strict: bool = False) -> str:
    """For each start line the first later row that is indented no deeper (strict: less deep); null if there is none.

    Per depth at which a block starts, the rows that may end it are put in order with the starts, last first, and the nearest one before is taken: linear in the
    rows for each depth.
    """
    cmp = "<" if strict else "<="
    levels = f"(SELECT DISTINCT doc_id, indent AS level FROM {starts} sl)"
    marks = f"SELECT r.doc_id, v.level, r.line_no, r.line_no AS mark, 0 AS starts FROM {rows} r JOIN {levels} v ON r.doc_id = v.doc_id AND r.indent {cmp} v.level"
    both = f"(SELECT * FROM ({marks}) m UNION ALL SELECT doc_id, indent AS level, line_no, NULL AS mark, 1 AS starts FROM {starts} s)"
    nearest = d.last_known("mark", "doc_id, level", "line_no DESC, starts DESC")
    return f"(SELECT doc_id, line_no, until FROM (SELECT doc_id, line_no, starts, {nearest} AS until FROM {both} b) n WHERE starts = 1)"


def flow_edges(d: Dialect, lines: str) -> str:
    """Control flow: to the next executable line, out of the function, both ways at a branch, and to what is called. 0 is the entry, -1 the exit."""
    nd = f"({flow_nodes(d, lines)})"
    nxt = f"(SELECT *, LEAD(line_no) OVER ({W}) AS next_line, ROW_NUMBER() OVER ({W}) AS place FROM {nd} n)"
    branches = f"(SELECT doc_id, line_no, indent FROM {nd} b WHERE kind = 'branch')"
    ends = _ends(d, branches, nd)
    step = """CASE WHEN next_line IS NULL OR kind IN ('return', 'throw') THEN -1 ELSE next_line END"""
    kind = "CASE WHEN kind = 'throw' THEN 'exception' WHEN next_line IS NULL THEN 'next' WHEN kind = 'return' THEN 'return' WHEN kind = 'branch' THEN 'true' ELSE 'next' END"
    return f"""SELECT doc_id, 0 AS src, line_no AS dst, 'next' AS kind FROM {nxt} a WHERE place = 1
      UNION ALL SELECT doc_id, line_no AS src, {step} AS dst, {kind} AS kind FROM {nxt} b
      UNION ALL SELECT x.doc_id, x.line_no AS src, COALESCE(e.until, -1) AS dst, 'false' AS kind FROM {nxt} x JOIN {ends} e ON x.doc_id = e.doc_id AND x.line_no = e.line_no WHERE x.kind = 'branch' AND x.next_line IS NOT NULL
      UNION ALL SELECT c.doc_id, c.line_no AS src, n.line_no AS dst, 'call' AS kind FROM ({calls(d, lines)}) c JOIN ({nodes(d, lines)}) n ON c.doc_id = n.doc_id AND c.callee = n.name JOIN {nd} f ON c.doc_id = f.doc_id AND c.line_no = f.line_no"""


def sanitizers(d: Dialect, x: str) -> str:
    """Kinds of sanitizers in an expression."""
    return d.labels([(d.any(x, p), k) for k, p in K.SANITIZER_KINDS])


def versions(d: Dialect, lines: str) -> str:
    """Single assignment form: each definition of a name numbered, with the version of the first-defined name that its expression uses."""
    assign = "CASE WHEN {m} THEN {a} END"
    name = f"COALESCE(NULLIF({d.extract('raw', K.ASSIGN, 1)}, ''), NULLIF({d.extract('raw', K.ASSIGN, 3)}, ''))"
    expr = f"COALESCE(NULLIF({d.extract('raw', K.ASSIGN, 2)}, ''), {d.extract('raw', K.ASSIGN, 4)})"
    one = f"(SELECT doc_id, line_no, 0 AS sub, {name} AS name, {d.strip(expr)} AS expression FROM {lines} l WHERE {d.match('raw', K.ASSIGN)})"
    split = "split" if d.name == "spark" else "string_split"
    parts = d.explode(f"(SELECT doc_id, line_no, raw, {split}({d.extract('raw', K.DESTRUCTURE, 1)}, ',') AS vars FROM {lines} l WHERE {d.match('raw', K.DESTRUCTURE)}) s", "vars", "part", "sub", "doc_id, line_no, raw")
    clean = d.strip(d.replace(d.replace(d.replace(d.strip("part"), r"^\*\*?", ""), r"[=:].*", ""), r"\s+as\s+\w+\z", ""))
    many = f"(SELECT doc_id, line_no, sub, {clean} AS name, concat({d.strip(d.extract('raw', K.DESTRUCTURE, 2))}, '.', {clean}) AS expression FROM {parts} p)"
    loop = f"(SELECT doc_id, line_no, 1000 AS sub, {d.extract('raw', K.FOR_IN, 1)} AS name, {d.strip(d.extract('raw', K.FOR_IN, 2))} AS expression FROM {lines} l WHERE {d.match('raw', K.FOR_IN)})"
    del assign
    defs = f"(SELECT * FROM {one} a UNION ALL SELECT * FROM {many} b WHERE {d.match('name', r'^\w+\z')} UNION ALL SELECT * FROM {loop} c)"
    numbered = f"(SELECT doc_id, line_no, name, expression, CAST(line_no AS BIGINT) * 10000 + sub AS ord, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id, name ORDER BY line_no, sub) AS INT) AS version FROM {defs} d)"
    words = d.explode(f"(SELECT doc_id, ord, {d.extract_all('expression', r'\w+')} AS words FROM {numbered} n) s", "words", "word", "pos", "doc_id, ord")
    firsts = f"(SELECT doc_id, name, ord AS first_ord FROM {numbered} f WHERE version = 1)"
    uses = f"(SELECT w.doc_id, w.ord, w.word, MIN(f.first_ord) AS first_ord FROM {words} w JOIN {firsts} f ON w.doc_id = f.doc_id AND w.word = f.name AND f.first_ord < w.ord GROUP BY w.doc_id, w.ord, w.word)"
    chosen = f"(SELECT doc_id, ord, word FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, ord ORDER BY first_ord) AS place FROM {uses} u) v WHERE place = 1)"
    # as of: the last version of the used name before the use
    stream = f"(SELECT doc_id, name AS k, ord, version, 0 AS is_use FROM {numbered} a UNION ALL SELECT doc_id, word AS k, ord, NULL AS version, 1 AS is_use FROM {chosen} b)"
    asof = f"(SELECT doc_id, k, ord, is_use, {d.last_known('version', 'doc_id, k', 'ord, is_use DESC')} AS v FROM {stream} s)"
    return f"""SELECT n.doc_id, n.name, n.version, n.line_no, n.expression, {sanitizers(d, 'n.expression')} AS sanitized_for, CASE WHEN a.k IS NOT NULL THEN concat(a.k, '_', CAST(a.v AS VARCHAR(12))) END AS depends_on
      FROM {numbered} n LEFT JOIN (SELECT * FROM {asof} t WHERE is_use = 1) a ON n.doc_id = a.doc_id AND n.ord = a.ord"""


def traces(d: Dialect, lines: str) -> str:
    """The last four versions of each name, told in order."""
    v = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, name ORDER BY version DESC) AS back FROM ({versions(d, lines)}) v)"
    told = f"concat(name, '_', CAST(version AS VARCHAR(12)), '@L', CAST(line_no AS VARCHAR(12)), ' = ', {d.left('expression', 80)})"
    return f"SELECT doc_id, name, CAST(COUNT(*) AS BIGINT) AS shown, {d.collect(told, 'version', ' | ')} AS trace FROM {v} x WHERE back <= 4 GROUP BY doc_id, name"


def constants(d: Dialect, lines: str) -> str:
    """Names that are set to a literal; the last such line counts."""
    name = f"COALESCE(NULLIF({d.extract('raw', K.CONSTANT, 1)}, ''), {d.extract('raw', K.CONSTANT, 3)})"
    value = d.strip(f"COALESCE(NULLIF({d.extract('raw', K.CONSTANT, 2)}, ''), {d.extract('raw', K.CONSTANT, 4)})")
    rows = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, name ORDER BY line_no DESC) AS place FROM (SELECT doc_id, line_no, {name} AS name, {value} AS value FROM {lines} l WHERE {d.match('raw', K.CONSTANT)}) x WHERE {d.match('value', K.LITERAL)})"
    return f"SELECT doc_id, name, line_no, value FROM {rows} r WHERE place = 1"


def dead_starts(d: Dialect, lines: str) -> str:
    """Branches that are never taken, and lines that return, throw or raise."""
    cond = d.strip(f"COALESCE(NULLIF({d.extract('raw', K.IF_PAREN, 1)}, ''), {d.extract('raw', K.IF_COLON, 1)})")
    q = "^['\"`]|['\"`]\\z"
    ifs = f"(SELECT doc_id, line_no, indent, {cond} AS cond FROM {lines} l WHERE {d.match('raw', K.IF_PAREN)} OR {d.match('raw', K.IF_COLON)})"
    eq = f"(SELECT *, {d.extract('cond', K.COMPARE, 1)} AS lhs, {d.extract('cond', K.COMPARE, 2)} AS op, {d.replace(d.extract('cond', K.COMPARE, 3), q, '')} AS rhs FROM {ifs} i)"
    known = f"(SELECT doc_id, name, {d.replace('value', q, '')} AS val FROM ({constants(d, lines)}) c)"
    never = f"(SELECT e.doc_id, e.line_no, e.indent FROM {eq} e LEFT JOIN {known} k ON e.doc_id = k.doc_id AND e.lhs = k.name AND e.lhs <> '' WHERE {d.match('cond', '^(?:false|False|0)\\z')} OR (NOT {d.match('cond', '^(?:true|True|1)\\z')} AND k.val IS NOT NULL AND ((op IN ('!=', '!==') AND k.val = rhs) OR (op IN ('==', '===') AND k.val <> rhs))))"
    stops = f"(SELECT doc_id, line_no, indent FROM {lines} l WHERE {d.match('raw', K.STOP)})"
    return f"SELECT DISTINCT doc_id, line_no, indent FROM (SELECT * FROM {never} n UNION ALL SELECT * FROM {stops} s) u"


def dead(d: Dialect, lines: str) -> str:
    """Lines that cannot run: deeper than a branch that is never taken, or than a return, throw or raise before them, up to the first that is no deeper."""
    ends = f"(SELECT doc_id, line_no, COALESCE(until, 2147483647) AS until FROM {_ends(d, f'({dead_starts(d, lines)})', lines)} e)"
    # spans as steps up and down; a line is dead where their running sum is above zero
    steps = f"(SELECT doc_id, line_no + 1 AS line_no, 1 AS step FROM {ends} a UNION ALL SELECT doc_id, until AS line_no, -1 AS step FROM {ends} b)"
    summed = f"(SELECT doc_id, line_no, SUM(step) AS step FROM {steps} s GROUP BY doc_id, line_no)"
    depth = f"(SELECT l.doc_id, l.line_no, SUM(COALESCE(s.step, 0)) OVER (PARTITION BY l.doc_id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth FROM {lines} l LEFT JOIN {summed} s ON l.doc_id = s.doc_id AND l.line_no = s.line_no)"
    return f"SELECT doc_id, line_no FROM {depth} x WHERE depth > 0"


def path_facts(d: Dialect, lines: str) -> str:
    """Guards and sanitizers, the name they are about, and the last line that they protect."""
    guard = f"COALESCE(NULLIF({d.extract('raw', K.GUARD, 1, 'i')}, ''), NULLIF({d.extract('raw', K.GUARD, 2, 'i')}, ''))"
    rows = f"(SELECT doc_id, line_no, indent, trimmed, {guard} AS guard, {sanitizers(d, 'raw')} AS kinds, MAX(line_no) OVER (PARTITION BY doc_id) AS last_line FROM {lines} l)"
    facts = f"(SELECT *, {d.left('COALESCE(guard, trimmed)', 120)} AS condition FROM {rows} r WHERE guard IS NOT NULL OR kinds <> '')"
    solid = f"(SELECT * FROM {lines} l WHERE trimmed <> '')"
    ends = _ends(d, f"(SELECT doc_id, line_no, indent FROM {facts} f)", solid, True)
    return f"SELECT f.doc_id, f.line_no, NULLIF({d.extract('condition', r'\b([A-Za-z_]\w*)\b', 1)}, '') AS variable, CASE WHEN kinds = '' THEN 'schema' ELSE kinds END AS sanitizers, condition, CAST(COALESCE(e.until, LEAST(last_line, f.line_no + 80)) AS INT) AS protects_until FROM {facts} f JOIN {ends} e ON f.doc_id = e.doc_id AND f.line_no = e.line_no"


def functions(d: Dialect, lines: str) -> str:
    """Function definitions with their parameters and whether the first return of their next 25 lines names each."""
    js, py = K.FUNCTION_JS, K.FUNCTION_PY
    name = f"COALESCE(NULLIF({d.extract('raw', js, 1)}, ''), NULLIF({d.extract('raw', js, 3)}, ''), NULLIF({d.extract('raw', py, 1)}, ''))"
    params = f"CASE WHEN {d.match('raw', js)} THEN COALESCE(NULLIF({d.extract('raw', js, 2)}, ''), {d.extract('raw', js, 4)}) ELSE {d.extract('raw', py, 2)} END"
    rows = f"(SELECT doc_id, line_no, raw, {d.near('raw', 'doc_id', 'line_no', 0, 24)} AS body FROM {lines} l)"
    return f"SELECT doc_id, line_no, {name} AS name, {d.strip(params)} AS params, {d.strip(d.extract('body', r'return\s+([^;\n}]+)', 1))} AS returns FROM {rows} r WHERE {d.match('raw', js)} OR {d.match('raw', py)}"


def imports(d: Dialect, lines: str) -> str:
    """Names that files import, each with its module."""
    py = f"(SELECT doc_id, line_no, file, COALESCE(NULLIF({d.extract('raw', K.IMPORT_PY, 2)}, ''), {d.extract('raw', K.IMPORT_PY, 3)}) AS names, COALESCE(NULLIF({d.extract('raw', K.IMPORT_PY, 1)}, ''), {d.extract('raw', K.IMPORT_PY, 3)}) AS module FROM {lines} l WHERE {d.match('raw', K.IMPORT_PY)})"
    js = f"(SELECT doc_id, line_no, file, COALESCE(NULLIF({d.extract('raw', K.IMPORT_JS, 1)}, ''), NULLIF({d.extract('raw', K.IMPORT_JS, 2)}, ''), {d.extract('raw', K.IMPORT_JS, 3)}) AS names, {d.extract('raw', K.IMPORT_JS, 4)} AS module FROM {lines} l WHERE {d.match('raw', K.IMPORT_JS)})"
    req = f"(SELECT doc_id, line_no, file, COALESCE(NULLIF({d.extract('raw', K.REQUIRE, 1)}, ''), {d.extract('raw', K.REQUIRE, 2)}) AS names, {d.extract('raw', K.REQUIRE, 3)} AS module FROM {lines} l WHERE {d.match('raw', K.REQUIRE)})"
    split = "split" if d.name == "spark" else "string_split"
    each = d.explode(f"(SELECT *, {split}(names, ',') AS list FROM (SELECT * FROM {py} a UNION ALL SELECT * FROM {js} b UNION ALL SELECT * FROM {req} c) u) s", "list", "part", "pos", "doc_id, line_no, file, module")
    clean = d.strip(d.replace(d.replace(d.strip("part"), r"[=:].*", ""), r"\s+as\s+\w+\z", ""))
    return f"SELECT doc_id, line_no, CAST(pos AS INT) AS pos, file, {clean} AS name, module FROM {each} e WHERE {clean} <> ''"


def symbols(d: Dialect, lines: str) -> str:
    """Exported names, classes and models, and lines that guard access."""
    parts = [
        ("export", d.extract("raw", K.EXPORT, 1), d.match("raw", K.EXPORT)),
        ("model", d.extract("raw", K.CLASS, 1), f"({d.match('raw', K.CLASS)} AND {d.match('raw', K.MODEL)})"),
        ("class", d.extract("raw", K.CLASS, 1), f"({d.match('raw', K.CLASS)} AND NOT {d.match('raw', K.MODEL)})"),
        ("auth", "fn", d.match("raw", K.AUTH_SYMBOL, "i")),
    ]
    rows = f"({enclosing(d, lines, '<module>')})"
    return " UNION ALL ".join(f"SELECT doc_id, line_no, '{k}' AS kind, {x} AS name FROM {rows} r{i} WHERE {c}" for i, (k, x, c) in enumerate(parts))


def routes(d: Dialect, lines: str) -> str:
    """Decorated routes: method, path, handler, whether the path is sensitive and whether a guard stands around the handler."""
    pat = K.ROUTE_PY
    rows = f"""(SELECT *, {d.near('raw', 'doc_id', 'line_no', 0, 7)} AS ahead, {d.near('raw', 'doc_id', 'line_no', 4, 11)} AS around, {d.near('raw', 'doc_id', 'line_no', 4, 18)} AS wide FROM {lines} l)"""
    method = f"{d.extract('raw', pat, 1)}"
    handler = d.extract("ahead", r"\n\s*(?:async\s+)?def\s+(\w+)\s*\(", 1)
    guard = d.match("around", K.ROUTE_GUARD, "i")
    return f"""SELECT doc_id, line_no, CASE WHEN {method} = 'route' THEN 'ANY' ELSE upper({method}) END AS method, {d.extract('raw', pat, 2)} AS path, CASE WHEN {handler} = '' THEN '<unknown>' ELSE {handler} END AS handler,
      {d.match(d.extract('raw', pat, 2), K.SENSITIVE_PATH, 'i')} AS sensitive, {guard} AS auth_guard FROM {rows} r WHERE {d.match('raw', pat)}"""


def http_routes(d: Dialect, lines: str) -> str:
    """Routes registered by call, each pattern on its own, with a guard in the lines around."""
    rows = f"(SELECT *, {d.near('raw', 'doc_id', 'line_no', 5, 9)} AS around FROM {lines} l)"
    auth = d.any("around", K.DELTA_AUTH)
    return " UNION ALL ".join(f"SELECT doc_id, line_no, {i} AS pattern, {d.extract('raw', p, g)} AS route, {auth} AS has_auth FROM {rows} r{i} WHERE {d.match('raw', p)}" for i, (p, g) in enumerate(K.DELTA_ROUTES))


def guard_level(d: Dialect) -> str:
    """The first kind of guard that a line matches."""
    return "CASE " + " ".join(f"WHEN {d.match('raw', p, 'i')} THEN '{k}'" for p, k in K.AUTH_BOUNDARIES) + " END"


def guards(d: Dialect, lines: str) -> str:
    """Lines that guard access, by the first kind that they match."""
    return f"SELECT doc_id, line_no, level, {d.left('trimmed', 60)} AS guard_name FROM (SELECT *, {guard_level(d)} AS level FROM {lines} l) x WHERE level IS NOT NULL"


def reachability(d: Dialect, lines: str) -> str:
    """Who can reach each line: dead and internal code by the lines around, else the nearest guard in the 40 lines before."""
    rows = f"(SELECT l.*, {d.near('l.raw', 'l.doc_id', 'l.line_no', 15, 15)} AS around, {d.last_known('g.line_no', 'l.doc_id', 'l.line_no')} AS guard_line, {d.last_known('g.level', 'l.doc_id', 'l.line_no')} AS guard_level FROM {lines} l LEFT JOIN ({guards(d, lines)}) g ON l.doc_id = g.doc_id AND l.line_no = g.line_no)"
    return reached_by(d, rows)


def reach_flags(d: Dialect, text: str) -> dict[str, str]:
    """What a text says about who reaches it."""
    return {"is_dead": d.any(text, K.REACH_DEAD), "dev_only": d.any(text, [(p, "i") for p in K.REACH_DEV]), "internal": d.any(text, [(p, "i") for p in K.REACH_INTERNAL])}


def reached_by(d: Dialect, rows: str) -> str:
    """reachability() of rows (doc_id, line_no, around, guard_line, guard_level) that know the lines around and the last guard."""
    made = ", ".join(f"{v} AS {k}" for k, v in reach_flags(d, "around").items())
    return who_reaches(d, f"(SELECT doc_id, line_no, {made}, CASE WHEN line_no - guard_line <= 40 THEN guard_level END AS level FROM {rows} r)")


def who_reaches(d: Dialect, flags: str) -> str:
    """reachability() of rows (doc_id, line_no, is_dead, dev_only, internal, level)."""
    who = "CASE WHEN is_dead THEN 'dead-code' WHEN internal THEN 'internal' WHEN level = 'admin' THEN 'admin-only' WHEN level = 'login' THEN 'external-auth' ELSE 'external-anon' END"
    score = "CASE WHEN is_dead THEN 0 WHEN dev_only THEN 10 WHEN internal THEN 20 WHEN level = 'admin' THEN 30 WHEN level = 'login' THEN 70 ELSE 100 END"
    high = f"CASE WHEN is_dead OR dev_only THEN 'low' WHEN {who} IN ('admin-only', 'internal') THEN 'medium' ELSE 'high' END"
    return f"SELECT doc_id, line_no, {who} AS attacker, {score} AS reach_score, {high} AS severity_of_high FROM {flags} f"


def line_scores(d: Dialect, lines: str) -> str:
    """How much each line matters for security, and why."""
    weight = " + ".join(f"CASE WHEN {d.match('raw', p, f)} THEN {w} ELSE 0 END" for p, f, w, _ in K.CRITICAL)
    assign = d.match("raw", r"(?:const|let|var)\s+\w+\s*=.*req\.")
    return f"SELECT doc_id, line_no, {weight} - CASE WHEN {d.any('raw', K.BOILERPLATE)} THEN 3 ELSE 0 END + CASE WHEN {assign} THEN 4 ELSE 0 END AS score, {d.labels([*((d.match('raw', p, f), k) for p, f, _, k in K.CRITICAL), (assign, 'taint-assign')])} AS labels, trimmed = '' AS blank FROM {lines} l"


def density(d: Dialect, lines: str) -> str:
    mean = f"CAST(SUM(CASE WHEN blank THEN 0 ELSE GREATEST(0, score) END) AS DOUBLE) / NULLIF(COUNT(CASE WHEN NOT blank THEN 1 END), 0)"
    return f"SELECT doc_id, COALESCE(LEAST(100, {d.half_up(f'{mean} * {d.num(20.0)}')}), 0) AS density FROM ({line_scores(d, lines)}) s GROUP BY doc_id"


def surface(d: Dialect, lines: str) -> str:
    """Functions, sinks, sources and tangled lines of each document, and the risk level that they make."""
    n = lambda p, w: f"{d.size(d.extract_all('raw', p))} * {w}"
    tangle = f"({n(r'\bif\b|\belse\b|\bwhile\b|\bfor\b|\btry\b|\bcatch\b', 2)} + {n(r'\bthen\b|\basync\b|\bawait\b', 1)} + {n(r'\[.*?\]', 1)} + {n(r'`[^`]*\$\{', 3)})"
    sinks = d.count_of(d.match("raw", p) for _, p in K.SURFACE_SINKS)
    sources = d.count_of(d.match("raw", p) for _, p in K.SURFACE_SOURCES)
    rows = f"(SELECT doc_id, {tangle} AS tangle, {sinks} AS sinks, {sources} AS sources, CASE WHEN {d.match('raw', r'(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*\(')} THEN 1 ELSE 0 END AS fns FROM {lines} l)"
    sums = f"(SELECT doc_id, CAST(SUM(fns) AS BIGINT) AS functions, CAST(SUM(sinks) AS BIGINT) AS sinks, CAST(SUM(sources) AS BIGINT) AS sources, CAST(COUNT(CASE WHEN tangle >= 5 THEN 1 END) AS BIGINT) AS hotspots, CAST(COUNT(CASE WHEN sinks > 0 AND sources > 0 THEN 1 END) AS BIGINT) AS high_risk FROM {rows} r GROUP BY doc_id)"
    risk = "(sinks * 10 + high_risk * 8 + sources * 5 + hotspots * 3)"
    return f"SELECT *, CASE WHEN {risk} >= 30 THEN 'high' WHEN {risk} >= 10 THEN 'medium' ELSE 'low' END AS risk_level FROM {sums} s"


def prioritize(d: Dialect, issues: str, lines: str) -> str:
    """Findings by how close they are to sinks and sources of their document: exact lines by equality, three lines around by frames over the lines."""
    hit = lambda t: d.any("raw", [p for _, p in t])
    rows = f"(SELECT doc_id, line_no, {hit(K.SURFACE_SINKS)} AS sink, {hit(K.SURFACE_SOURCES)} AS source FROM {lines} l)"
    near = f"(SELECT *, MAX(CASE WHEN sink THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS close FROM {rows} r)"
    pr = "CASE WHEN n.sink AND n.source THEN 30 ELSE 0 END + CASE WHEN n.sink THEN 25 ELSE 0 END + CASE WHEN n.source THEN 15 ELSE 0 END + CASE WHEN n.close = 1 THEN 10 ELSE 0 END"
    scored = f"(SELECT i.doc_id, i.seq, COALESCE({pr}, 0) AS priority FROM {issues} i LEFT JOIN {near} n ON i.doc_id = n.doc_id AND i.line = n.line_no)"
    return f"SELECT doc_id, seq, priority, CAST(ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY priority DESC, seq) AS INT) AS place FROM {scored} s"
