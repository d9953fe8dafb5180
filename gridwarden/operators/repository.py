"""Files of a repository together: which file an import names, values that go from file to file, and what is reached over imports.

files: (repo, doc_id, path, code); lines: the lines of those files that parse() and flow.flagged() make. What a file says by itself is put down as facts, one narrow pass
over its lines each, and only facts meet those of other files; so a file that did not change need not be read again.
A name is a node "doc_id:name". Values go from file to file as arguments of a call to an imported function, and back as what its return names.
"""

from __future__ import annotations

from ..functions import flow_values as V
from ..functions import rule_values as R
from ..functions.dialect import Dialect
from . import flow, system
from . import lines as L


def _list(d: Dialect, x: str, sep: str) -> str:
    return f"split({x}, {d.text(sep)})" if d.name == "spark" else f"string_split({x}, {d.text(sep)})"


def _up(d: Dialect, folder: str, n: str) -> str:
    """A folder's path without its last n parts; null above the top."""
    parts = _list(d, folder, "/")
    rest = f"GREATEST(0, CAST({d.size(parts)} - {n} AS INT))"
    kept = f"array_join(slice({parts}, 1, {rest}), '/')" if d.name == "spark" else f"array_to_string(list_slice({parts}, 1, {rest}), '/')"
    depth = f"CASE WHEN {folder} = '' THEN 0 ELSE {d.size(parts)} END"
    return f"CASE WHEN {n} <= {depth} THEN {kept} END"


def modules(d: Dialect, files: str) -> str:
    """(repo, doc_id, module, folder): what a file is called when it is imported. An index or __init__ stands for its folder."""
    bare = d.replace("path", r"\.\w+\z", "")
    folder = d.replace("path", r"[^/]*\z", "")
    return f"SELECT repo, doc_id, {d.replace(bare, r'(?:^|/)(?:index|__init__)\z', '')} AS module, {d.replace(folder, r'/\z', '')} AS folder, {d.match('path', r'\.py\z')} AS python FROM {files} m"


def facts(d: Dialect, lines: str, files: str) -> str:
    """(repo, doc_id, fact, line_no, name, place, word): what each file says. Of lines that can run: seed (name), edge (name to word), import (name from word), arg (word at a place of a call of name), made (word is set to a call of name); of definitions: param, return."""
    live = f"(SELECT * FROM {lines} lf WHERE NOT dead)"
    made = lambda p: f"SELECT doc_id, 'made' AS fact, line_no, {d.extract('raw', p, 2)} AS name, 0 AS place, {d.extract('raw', p, 1)} AS word FROM {live} l WHERE {d.match('raw', p)}"
    calls = d.explode(f"(SELECT doc_id, line_no, {d.extract_all('raw', L.K.CALL)} AS found FROM {live} l) s", "found", "told", "pos", "doc_id, line_no")
    args = d.explode(f"(SELECT doc_id, line_no, {d.extract('told', L.K.CALL, 1)} AS name, {_list(d, d.extract('told', L.K.CALL, 2), ',')} AS args FROM {calls} c) s", "args", "arg", "place", "doc_id, line_no, name")
    words = d.explode(f"(SELECT doc_id, line_no, name, place, {d.any_word('arg')} AS words FROM {args} a) s", "words", "word", "pos", "doc_id, line_no, name, place")
    first = f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, name ORDER BY line_no) AS nth FROM ({L.functions(d, lines)}) f) g WHERE nth = 1 AND name <> '')"
    params = d.explode(f"(SELECT doc_id, line_no, name, {_list(d, 'params', ',')} AS params FROM {first} p) s", "params", "param", "place", "doc_id, line_no, name")
    clean = d.strip(d.replace(d.replace("param", r"[=:].*", ""), r"^\s*(?:\.\.\.|\*\*?)", ""))
    returns = d.explode(f"(SELECT doc_id, line_no, name, {d.any_word('returns')} AS words FROM {first} r) s", "words", "word", "pos", "doc_id, line_no, name")
    parts = [
        f"SELECT doc_id, 'seed' AS fact, line_no, var AS name, 0 AS place, '' AS word FROM ({flow.seeds(d, lines)}) s",
        f"SELECT doc_id, 'edge' AS fact, line_no, src AS name, 0 AS place, dst AS word FROM ({flow.edges(d, lines)}) e",
        f"SELECT doc_id, 'import' AS fact, line_no, name, 0 AS place, module AS word FROM ({L.imports(d, live)}) i",
        f"SELECT doc_id, 'arg' AS fact, line_no, name, place, word FROM {words} w",
        made(R.CALL_ALIAS),
        made(V.FLOW_MADE),
        f"SELECT doc_id, 'param' AS fact, line_no, name, place, {clean} AS word FROM {params} p WHERE {clean} <> ''",
        f"SELECT doc_id, 'return' AS fact, line_no, name, 0 AS place, word FROM {returns} r",
    ]
    union = " UNION ALL ".join(f"SELECT doc_id, fact, CAST(line_no AS INT) AS line_no, name, CAST(place AS INT) AS place, word FROM ({p}) u{i}" for i, p in enumerate(parts))
    return f"SELECT DISTINCT f.repo, u.doc_id, u.fact, u.line_no, u.name, u.place, u.word FROM ({union}) u JOIN {files} f ON u.doc_id = f.doc_id"


def _of(facts: str, fact: str) -> str:
    return f"(SELECT repo, doc_id, line_no, name, place, word FROM {facts} f_{fact} WHERE fact = '{fact}')"


def links(d: Dialect, facts: str, files: str) -> str:
    """(repo, doc_id, name, module, target): imports that name a file of the repository.

    Paths begin at the importing file's folder (./ and ../, or the dots of Python), at src/ (@/), or at the top; what a Python module hands out may be a file itself.
    """
    own = f"({modules(d, files)})"
    dots = d.extract("word", r"^\.+", 0)
    steps = f"CASE WHEN python THEN length({dots}) - 1 ELSE {d.size(d.extract_all('word', r'\.\./'))} END"
    rest = f"CASE WHEN python THEN replace({d.replace('word', r'^\.+', '')}, '.', '/') ELSE {d.replace(d.replace('word', r'^(?:\.\.?/)+', ''), r'\.(?:jsx?|tsx?|mjs|cjs)\z', '')} END"
    base = f"CASE WHEN {d.match('word', r'^\.')} THEN {_up(d, 'folder', steps)} WHEN {d.match('word', '^@/')} THEN 'src' ELSE '' END"
    tail = d.replace(rest, "^@/", "")
    joined = f"(SELECT *, CASE WHEN base = '' THEN tail WHEN tail = '' THEN base ELSE concat(base, '/', tail) END AS path FROM (SELECT i.repo, i.doc_id, i.name, i.word, m.python, {base} AS base, {tail} AS tail FROM {_of(facts, 'import')} i JOIN {own} m ON i.repo = m.repo AND i.doc_id = m.doc_id) b WHERE base IS NOT NULL)"
    named = f"(SELECT repo, doc_id, name, word, path FROM {joined} j UNION ALL SELECT repo, doc_id, name, word, CASE WHEN path = '' THEN name ELSE concat(path, '/', name) END AS path FROM {joined} k WHERE python)"
    return f"SELECT DISTINCT n.repo, n.doc_id, n.name, n.word AS module, t.doc_id AS target FROM {named} n JOIN {own} t ON n.repo = t.repo AND n.path = t.module WHERE n.path <> '' AND n.doc_id <> t.doc_id"


def _node(d: Dialect, doc: str, name: str) -> str:
    return f"concat(CAST({doc} AS VARCHAR(20)), ':', {name})"


def seeds(d: Dialect, facts: str) -> str:
    """(scope, node, origin): names that a source sets, and the node itself as origin."""
    node = _node(d, "doc_id", "name")
    return f"SELECT DISTINCT repo AS scope, {node} AS node, {node} AS origin FROM {_of(facts, 'seed')} s"


def edges(d: Dialect, facts: str, links: str) -> str:
    """(scope, src, dst) between names: those within files, arguments to parameters of imported functions, and what these return to what is set to their call.

    What is set to a call of an imported function of the repository gets what the function returns, and not its arguments for that alone.
    """
    known = f"(SELECT m.repo, m.doc_id, m.line_no, m.word, m.name, k.target FROM {_of(facts, 'made')} m JOIN {links} k ON m.repo = k.repo AND m.doc_id = k.doc_id AND m.name = k.name JOIN (SELECT DISTINCT repo, doc_id, name FROM {_of(facts, 'return')} rt) t ON k.repo = t.repo AND k.target = t.doc_id AND k.name = t.name)"
    here = f"SELECT e.repo, {_node(d, 'e.doc_id', 'e.name')} AS src, {_node(d, 'e.doc_id', 'e.word')} AS dst FROM {_of(facts, 'edge')} e LEFT JOIN (SELECT DISTINCT repo, doc_id, line_no, word FROM {known} kn) x ON e.repo = x.repo AND e.doc_id = x.doc_id AND e.line_no = x.line_no AND e.word = x.word WHERE x.repo IS NULL"
    given = f"SELECT a.repo, {_node(d, 'a.doc_id', 'a.word')} AS src, {_node(d, 'p.doc_id', 'p.word')} AS dst FROM {_of(facts, 'arg')} a JOIN {links} k ON a.repo = k.repo AND a.doc_id = k.doc_id AND a.name = k.name JOIN {_of(facts, 'param')} p ON k.repo = p.repo AND k.target = p.doc_id AND k.name = p.name AND a.place = p.place"
    back = f"SELECT r.repo, {_node(d, 'r.doc_id', 'r.word')} AS src, {_node(d, 'm.doc_id', 'm.word')} AS dst FROM {known} m JOIN {_of(facts, 'return')} r ON m.repo = r.repo AND m.target = r.doc_id AND m.name = r.name"
    return f"SELECT DISTINCT repo AS scope, src, dst FROM ({here} UNION ALL {given} UNION ALL {back}) u WHERE src <> dst"


def tainted(d: Dialect, reached: str, facts: str) -> str:
    """(doc_id, var, pass_no, line_no, hops, origin) of a fixpoint over nodes, in the form that findings take; sources keep their last line."""
    parted = f"(SELECT scope, CAST({d.extract('node', '^([0-9-]+):', 1)} AS BIGINT) AS doc_id, {d.extract('node', '^[0-9-]+:(.*)', 1)} AS var, hops, origin FROM {reached} rc)"
    at = f"(SELECT doc_id, name, MAX(line_no) AS line_no FROM {_of(facts, 'seed')} sd GROUP BY doc_id, name)"
    return f"SELECT r.doc_id, r.var, CASE WHEN r.hops = 0 THEN 0 ELSE 1 END AS pass_no, CASE WHEN r.hops = 0 THEN COALESCE(s.line_no, 0) ELSE 0 END AS line_no, CAST(r.hops AS INT) AS hops, r.origin FROM {parted} r LEFT JOIN {at} s ON r.doc_id = s.doc_id AND r.var = s.name"


def findings(d: Dialect, lines: str, tainted: str, files: str) -> str:
    """Tainted names at sinks, as flow.sink_findings() tells them, with the repository and the source's document and name: across if that is another file."""
    return with_sources(d, f"({flow.sink_findings(d, lines, tainted)})", tainted, files)


def with_sources(d: Dialect, found: str, tainted: str, files: str) -> str:
    """findings() of what flow.sink_findings() found."""
    told = f"(SELECT DISTINCT doc_id, var, hops, origin FROM {tainted} tn)"
    origin = f"CAST({d.extract('t.origin', '^([0-9-]+):', 1)} AS BIGINT)"
    return f"""SELECT f.repo, s.doc_id, f.path, s.line_no, s.sink, s.var, s.cwe, s.severity, s.reachability, s.exploitability, s.confidence, t.hops, {origin} AS source_doc, {d.extract('t.origin', '^[0-9-]+:(.*)', 1)} AS source_var, {origin} <> s.doc_id AS across
      FROM {found} s JOIN {told} t ON s.doc_id = t.doc_id AND s.var = t.var JOIN {files} f ON s.doc_id = f.doc_id"""


def module_seeds(d: Dialect, marks: str) -> str:
    """(scope, node, origin): files that take input. marks: file_marks()."""
    node = "CAST(doc_id AS VARCHAR(20))"
    return f"SELECT repo AS scope, {node} AS node, doc_id AS origin FROM {marks} ms WHERE n_sources > 0 AND n_gates = 0"


def module_edges(d: Dialect, links: str) -> str:
    """(scope, src, dst): from the importing file to the imported one."""
    return f"SELECT DISTINCT repo AS scope, CAST(doc_id AS VARCHAR(20)) AS src, CAST(target AS VARCHAR(20)) AS dst FROM {links} me"


def file_marks(d: Dialect, lines: str, files: str) -> str:
    """(repo, doc_id, path, n_sources, n_sinks, n_gates): lines of each file that take input, that are dangerous, and that check who asks."""
    n = lambda k: f"CAST(COUNT(CASE WHEN g.kind = '{k}' THEN 1 END) AS BIGINT)"
    return f"SELECT f.repo, f.doc_id, f.path, {n('source')} AS n_sources, {n('sink')} AS n_sinks, {n('auth-gate')} AS n_gates FROM {files} f LEFT JOIN ({system.graph_nodes(d, lines)}) g ON f.doc_id = g.doc_id GROUP BY f.repo, f.doc_id, f.path"


def chains(d: Dialect, reached: str, marks: str) -> str:
    """Files with dangerous lines and no gate that input reaches over imports: how many files away, and from which. reached: the fixpoint over module_seeds() and module_edges()."""
    severity = "CASE WHEN r.hops = 0 THEN 'high' WHEN r.hops <= 2 THEN 'medium' ELSE 'low' END"
    return f"SELECT m.repo, m.doc_id, m.path, m.n_sinks, CAST(r.hops AS INT) AS hops, r.origin AS source_doc, {severity} AS severity FROM {marks} m JOIN {reached} r ON m.repo = r.scope AND CAST(m.doc_id AS VARCHAR(20)) = r.node WHERE m.n_sinks > 0 AND m.n_gates = 0"
