"""Taint: from sources along assignments and calls to sinks.

A document's variables are tainted in passes over its lines. A forward chain closes in the first pass, whatever its length; only a use above its
definition costs another, and there are four. So a variable's state is the earliest (pass, line) at which it is tainted, an edge at a later line
keeps the pass, one at an earlier line adds one, and the least state of each variable is a shortest path over the document's edges.

Everything is within a document: edges are collected per document and closed in one task, with one exchange by document. closure_sql() is the
same as a recursive query.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rule_values as R
from ..functions.dialect import Dialect
from ..functions.run import apply
from . import lines as L

PASSES = 4


def _list(d: Dialect, x: str, sep: str) -> str:
    return f"split({x}, {d.text(sep)})" if d.name == "spark" else f"string_split({x}, {d.text(sep)})"


def seeds(d: Dialect, lines: str) -> str:
    """Variables that sources name; the last line of each counts."""
    single = [f"CASE WHEN {d.match('raw', p)} THEN {d.extract('raw', p, 1)} END" for p, many in R.SOURCES if not many]
    several = [f"CASE WHEN {d.match('raw', p)} THEN {d.extract('raw', p, 1)} END" for p, many in R.SOURCES if many]
    words = d.extract_all(d.join([*single, *several], " "), r"\w+")
    each = d.explode(f"(SELECT doc_id, line_no, {words} AS words FROM {lines} l WHERE {d.any('raw', [p for p, _ in R.SOURCES])}) s", "words", "var", "pos", "doc_id, line_no")
    return f"SELECT doc_id, var, CAST(MAX(line_no) AS INT) AS line_no FROM {each} e WHERE var NOT IN ({', '.join(d.text(w) for w in R.NOT_NAMES)}) GROUP BY doc_id, var"


def edges(d: Dialect, lines: str) -> str:
    """(doc_id, src, dst, line_no): assignments from a variable, a template, a sum, or a call that hands its argument on.

    A function that the document does not define hands on; one that it defines, if its first return names the argument.
    """
    plain = " UNION ALL ".join(f"SELECT doc_id, line_no, {d.extract('body', p, 2)} AS src, {d.extract('body', p, 1)} AS dst FROM {lines} l{i} WHERE {d.match('body', p)}".replace("body", "raw") for i, p in enumerate(R.ALIASES))
    return f"SELECT DISTINCT doc_id, src, dst, line_no FROM ({plain} UNION ALL {calls(d, lines)}) u WHERE src <> dst"


def calls(d: Dialect, lines: str, only: str = "TRUE") -> str:
    """(doc_id, line_no, src, dst): arguments that a call hands on to what its value is assigned to. only: a condition on the line."""
    args = d.explode(f"(SELECT doc_id, line_no, {d.extract('raw', R.CALL_ALIAS, 1)} AS dst, {d.extract('raw', R.CALL_ALIAS, 2)} AS callee, {_list(d, d.extract('raw', R.CALL_ALIAS, 3), ',')} AS args FROM {lines} l WHERE {d.match('raw', R.CALL_ALIAS)} AND {only}) s", "args", "arg", "pos", "doc_id, line_no, dst, callee")
    firsts = f"(SELECT doc_id, name, returns FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, name ORDER BY line_no) AS place FROM ({L.functions(d, lines)}) f) g WHERE place = 1)"
    return f"SELECT a.doc_id, a.line_no, {d.strip('a.arg')} AS src, a.dst FROM {args} a LEFT JOIN {firsts} f ON a.doc_id = f.doc_id AND a.callee = f.name WHERE {d.strip('a.arg')} <> '' AND (f.name IS NULL OR {d.contains('f.returns', d.strip('a.arg'))})"


def settle(seeds: list, edges: list, passes: int = PASSES) -> list[tuple[str, int, int, int]]:
    """(variable, pass, line, hops) for all tainted ones: least states first, each variable settled once. Hops are the edges from a source on the way that gave the state."""
    out: dict[str, list[tuple[str, int]]] = {}
    for src, dst, line in edges:
        out.setdefault(src, []).append((dst, line))
    heap = [(0, line, 0, v) for v, line in seeds]
    heapq.heapify(heap)
    done: dict[str, tuple[int, int, int]] = {}
    while heap:
        p, line, hops, v = heapq.heappop(heap)
        if v in done:
            continue
        done[v] = (p, line, hops)
        # sources are known before the first pass starts
        at = (1, 0) if p == 0 else (p, line)
        for dst, edge_line in out.get(v, ()):
            if dst not in done:
                q = at[0] if edge_line > at[1] else at[0] + 1
                if q <= passes:
                    heapq.heappush(heap, (q, edge_line, hops + 1, dst))
    return [(v, *state) for v, state in done.items()]


def close(seeds: list, edges: list, passes: int = PASSES) -> list[tuple[str, int, int]]:
    """(variable, pass, line) for all tainted ones."""
    return [x[:3] for x in settle(seeds, edges, passes)]


def closure(seed_rows: DataFrame, edge_rows: DataFrame, passes: int = PASSES) -> DataFrame:
    """(doc_id, var, pass_no, line_no, hops) of the tainted variables of each document; pass 0 for sources."""
    state = T.ArrayType(T.StructType([T.StructField("var", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("pass_no", "line_no", "hops"))]))

    @F.pandas_udf(state)
    def closed(seeds, edges):
        import pandas as pd

        told = lambda a, b: settle([(s["var"], s["line_no"]) for s in a], [(e["src"], e["dst"], e["line_no"]) for e in b], passes)
        return pd.Series([[{"var": v, "pass_no": p, "line_no": n, "hops": h} for v, p, n, h in told(a, b)] for a, b in zip(seeds, edges, strict=True)])

    null = lambda t: F.lit(None).cast(t)
    seed_type, edge_type = "struct<var:string,line_no:int>", "struct<src:string,dst:string,line_no:int>"
    rows = seed_rows.select("doc_id", F.struct("var", F.col("line_no").cast("int").alias("line_no")).cast(seed_type).alias("seed"), null(edge_type).alias("edge")).unionByName(
        edge_rows.select("doc_id", null(seed_type).alias("seed"), F.struct("src", "dst", F.col("line_no").cast("int").alias("line_no")).cast(edge_type).alias("edge"))
    )
    per_doc = rows.groupBy("doc_id").agg(F.collect_list("seed").alias("seeds"), F.collect_list("edge").alias("edges")).where(F.size("seeds") > 0)
    return per_doc.select("doc_id", F.explode(closed("seeds", "edges")).alias("t")).select("doc_id", "t.*")


def tainted(lines: DataFrame) -> DataFrame:
    return closure(apply(seeds, lines=lines), apply(edges, lines=lines)).drop("hops")


def _walk(seed_sql: str, edge_sql: str) -> str:
    """Recursive relations: every state that variables can have, and st, the least of each."""
    later = "CASE WHEN e.line_no > w.ln THEN w.p ELSE w.p + 1 END"
    return f"""WITH RECURSIVE sd AS ({seed_sql}), eg AS ({edge_sql}),
      walk AS (SELECT doc_id, var, 1 AS p, 0 AS ln, 0 AS shown_pass, line_no AS shown_line FROM sd
        UNION SELECT w.doc_id, e.dst, {later}, e.line_no, {later}, e.line_no FROM walk w JOIN eg e ON w.doc_id = e.doc_id AND w.var = e.src WHERE {later} <= {PASSES}),
      st AS (SELECT doc_id, var, CAST(shown_pass AS INT) AS pass_no, CAST(shown_line AS INT) AS line_no, p, ln FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, var ORDER BY shown_pass, shown_line) AS place FROM walk) x WHERE place = 1)"""


def closure_sql(d: Dialect, lines: str) -> str:
    """The same closure as a recursive query, for engines that remove duplicates in recursion."""
    return f"{_walk(seeds(d, lines), edges(d, lines))} SELECT doc_id, var, pass_no, line_no FROM st"


def hops_sql(d: Dialect, seed_sql: str, edge_sql: str) -> str:
    """closure() with hops: a second walk, over the edges that give their target its state."""
    return f"""{_walk(seed_sql, edge_sql)},
      hop AS (SELECT doc_id, var, 0 AS hops FROM st WHERE pass_no = 0
        UNION SELECT h.doc_id, e.dst, h.hops + 1 FROM hop h JOIN st w ON h.doc_id = w.doc_id AND h.var = w.var JOIN eg e ON w.doc_id = e.doc_id AND w.var = e.src
          JOIN st t ON t.doc_id = e.doc_id AND t.var = e.dst AND t.pass_no > 0 AND t.line_no = e.line_no AND t.pass_no = CASE WHEN e.line_no > w.ln THEN w.p ELSE w.p + 1 END)
      SELECT s.doc_id, s.var, s.pass_no, s.line_no, CAST(MIN(h.hops) AS INT) AS hops FROM st s JOIN hop h ON s.doc_id = h.doc_id AND s.var = h.var GROUP BY s.doc_id, s.var, s.pass_no, s.line_no"""


def _some_in(d: Dialect, names: str, x: str) -> str:
    """True if a string of the list is part of x."""
    if d.name == "spark":
        return f"exists(COALESCE({names}, CAST(array() AS ARRAY<STRING>)), v -> contains({x}, v))"
    return f"(len(list_filter(COALESCE({names}, []), lambda v: contains({x}, v))) > 0)"


def guarded(d: Dialect, lines: str) -> str:
    """Lines within 14 after a check that returns or throws, which name the variable that it checks."""
    var = "CASE " + " ".join(f"WHEN {d.match('raw', p)} THEN " + (d.extract("raw", p, g) if g else "NULL") for p, g in R.GUARDS) + " END"
    rows = f"(SELECT doc_id, line_no, raw, {var} AS var FROM {lines} l)"
    frame = "OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)"
    past = f"collect_list(var) {frame}" if d.name == "spark" else f"list_filter(list(var) {frame}, lambda v: v IS NOT NULL)"
    return f"SELECT doc_id, line_no FROM (SELECT *, {past} AS past FROM {rows} r) x WHERE {_some_in(d, 'past', 'raw')}"


def sinks(d: Dialect, lines: str, tainted: str) -> str:
    """Lines where taint or a built query reaches a sink, by rule. Lines that a check guards are left out."""
    names = f"(SELECT doc_id, {'collect_list(var)' if d.name == 'spark' else 'list(var)'} AS names FROM {tainted} t GROUP BY doc_id)"
    rows = f"""(SELECT l.doc_id, l.line_no, l.raw, {d.near('l.raw', 'l.doc_id', 'l.line_no', 4, 4)} AS around, {d.near('l.raw', 'l.doc_id', 'l.line_no', 5, 0)} AS before, {d.near('l.raw', 'l.doc_id', 'l.line_no', 5, 1)} AS nearby, n.names
      FROM {lines} l LEFT JOIN {names} n ON l.doc_id = n.doc_id)"""
    live = f"(SELECT r.*, {_some_in(d, 'r.names', 'r.raw')} AS hot FROM {rows} r LEFT JOIN ({guarded(d, lines)}) g ON r.doc_id = g.doc_id AND r.line_no = g.line_no WHERE g.doc_id IS NULL)"
    m = lambda p, f="", x="raw": d.match(x, p, f)
    html = d.extract("raw", r"`[^`]*<[a-zA-Z][^`]*\$\{([^}]+)\}", 1)
    inner = d.extract("raw", r"\.innerHTML\s*=\s*([^;]+)", 1)
    unescaped = f"NOT {m(R.SQL_SAFE)}"
    rules = [
        ("sqli-taint", f"{m(r'db\.(?:query|execute|run)\s*\(|cursor\.execute\s*\(')} AND NOT {m(R.SQL_SAFE_CALL)} AND hot"),
        ("sqli-concat", f"{m(r'''[\"'][^\"']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE|FROM)[^\"']*[\"']\s*\+''', 'i')} AND {unescaped}"),
        ("sqli-template", f"{m(r'`[^`]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE|FROM)\s[^`]*\$\{', 'i')} AND {unescaped}"),
        ("sqli-python-fstring", f"{m(r'''(?:query|sql|stmt)\s*=\s*f[\"'].*(?:SELECT|INSERT|UPDATE|DELETE|WHERE|FROM)''', 'i')} AND {unescaped}"),
        ("sqli-python-percent", f"{m(r'''(?:query|sql|stmt)\s*=\s*[\"'][^\"']*(?:SELECT|INSERT|UPDATE|DELETE|WHERE|FROM)[^\"']*[\"']\s*%''', 'i')} AND {unescaped}"),
        ("xss-template", f"{html} <> '' AND NOT {m(R.HTML_SAFE, '', html)} AND hot"),
        ("xss-innerhtml", f"{inner} <> '' AND NOT {m(R.HTML_SAFE, '', inner)} AND hot"),
        ("xss-react", f"{m(r'dangerouslySetInnerHTML\s*=')} AND hot"),
        ("cmd-injection", f"{m(r'(?:exec|execSync|spawn|spawnSync|execFile|execFileSync)\s*\(')} AND hot AND NOT {m(r',\s*\[')}"),
        ("path-traversal", f"{m(r'(?:readFile|readFileSync|createReadStream|writeFile|writeFileSync)\s*\(')} AND hot AND NOT {m(R.PATH_SAFE, '', 'around')}"),
        ("path-join", f"{m(r'path\.join\s*\(')} AND hot AND NOT {m(R.PATH_SAFE, '', 'around')}"),
        ("open-redirect", f"{m(r'res\.redirect\s*\(')} AND hot AND NOT {m(r'(?:ALLOWED_HOSTS|allowedDomains|whitelist|allowlist)', 'i', 'before')} AND NOT {m(R.URL_SAFE, '', 'before')}"),
        ("proto-incomplete", f"{m(r'''!==\s*['\"]__proto__['\"]''')} AND {d.size(d.extract_all('around', '(?:constructor|prototype)'))} < 2"),
        ("header-injection", f"{m(r'setHeader\s*\(')} AND (hot OR {m(r'req\.(?:query|params|body)\.')}) AND NOT {m(R.CRLF_SAFE, '', 'nearby')}"),
    ]
    made = ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in rules)
    some = f"filter(array({made}), x -> x IS NOT NULL)" if d.name == "spark" else f"list_filter([{made}], lambda x: x IS NOT NULL)"
    each = d.explode(f"(SELECT doc_id, line_no, {some} AS found FROM {live} v) s", "found", "rule_id", "pos", "doc_id, line_no")
    return f"SELECT doc_id, CAST(line_no AS INT) AS line_no, rule_id FROM {each} e"
