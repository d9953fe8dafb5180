"""The rule engine: patterns on whole texts, found with their lines, and what is made of the hits."""

from __future__ import annotations

from ..functions import rule_values as R
from ..functions.dialect import Dialect


#: Line feeds of a match and of the gap before it are packed into one number with this factor.
_PACK = 1 << 31


def _split(d: Dialect, x: str, p: str) -> str:
    return f"split({x}, {d.text(p)}, -1)" if d.name == "spark" else f"string_split_regex({x}, {d.text(p)})"


def _newlines(d: Dialect, x: str) -> str:
    nl = "'\\n'" if d.name == "spark" else "chr(10)"
    return f"(length({x}) - length(replace({x}, {nl}, '')))"


def hits(d: Dialect, files: str, rules: list[tuple] | None = None) -> str:
    """(doc_id, rule, hit, line_no): every match of every rule, by the line that it starts in.

    One look at the text tells which rules match at all; only those are cut at their matches. A match's line is one more than the
    line feeds before it: a running sum over the gaps and matches in order.
    """
    rules = R.RULES if rules is None else rules
    made = ", ".join(f"CASE WHEN {d.match('code', r[1], r[2])} THEN {i} END" for i, r in enumerate(rules))
    if d.name == "spark":
        some = f"filter(array({made}), x -> x IS NOT NULL)"
    else:
        some = f"list_filter([{made}], lambda x: x IS NOT NULL)"
    matched = d.explode(f"(SELECT doc_id, code, {some} AS found FROM {files} f) s", "found", "rule_no", "nth", "doc_id, code")
    pick = lambda f: "CASE rule_no " + " ".join(f"WHEN {i} THEN {f(d.pattern(r[1], r[2]))}" for i, r in enumerate(rules)) + " END"
    cut = f"(SELECT doc_id, rule_no, {pick(lambda p: d.extract_all('code', p))} AS matches, {pick(lambda p: _split(d, 'code', p))} AS gaps FROM {matched} m)"
    # of each match only the line feeds before it and in it are kept, in one number, so that no text is copied once a match
    both = d.each("gaps", "x", _newlines(d, "x")), d.each("matches", "x", _newlines(d, "x"))
    packed = f"zip_with({both[0]}, {both[1]}, (g, m) -> CAST(g AS BIGINT) * {_PACK} + m)" if d.name == "spark" else f"list_transform(list_zip({both[0]}, {both[1]}), lambda z: CAST(z[1] AS BIGINT) * {_PACK} + z[2])"
    each = d.explode(f"(SELECT doc_id, rule_no, {packed} AS packed FROM {cut} c) s", "packed", "pack", "hit", "doc_id, rule_no")
    w = "PARTITION BY doc_id, rule_no ORDER BY hit"
    counted = f"(SELECT doc_id, rule_no, hit, CAST(FLOOR(pack / {d.num(float(_PACK))}) AS BIGINT) AS g, pack % {_PACK} AS m FROM {each} e WHERE pack IS NOT NULL)"
    run = f"SUM(g) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + COALESCE(SUM(m) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return f"SELECT doc_id, CAST(rule_no AS INT) AS rule_no, CAST(hit AS INT) AS hit, CAST(1 + {run} AS INT) AS line_no FROM {counted} c"


def findings(d: Dialect, files: str, rules: list[tuple] | None = None) -> str:
    """Hits once per rule and line, without those that a safe pattern on the line mitigates; some rules once per file."""
    rules = R.RULES if rules is None else rules
    first = f"(SELECT h.doc_id, h.rule_no, h.line_no, MIN(h.hit) AS hit FROM ({hits(d, files, rules)}) h GROUP BY h.doc_id, h.rule_no, h.line_no)"
    line = d.window("code", "line_no", "line_no")
    joined = f"(SELECT h.*, {line} AS raw FROM {first} h JOIN {files} f ON h.doc_id = f.doc_id)"
    safe = "CASE rule_no " + " ".join(f"WHEN {i} THEN {d.any('raw', r[6])}" for i, r in enumerate(rules) if r[6]) + " ELSE FALSE END"
    once = [i for i, r in enumerate(rules) if r[0] in R.ONCE]
    only = f"(rule_no NOT IN ({', '.join(map(str, once))}) OR place = 1)" if once else "TRUE"
    kept = f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, rule_no ORDER BY hit) AS place FROM {joined} j WHERE NOT {safe})"
    names = {i: r for i, r in enumerate(rules)}
    label = lambda k: "CASE rule_no " + " ".join(f"WHEN {i} THEN '{r[k]}'" for i, r in names.items()) + " END"
    return f"SELECT doc_id, rule_no, {label(0)} AS rule_id, {label(3)} AS severity, {label(4)} AS category, line_no FROM {kept} k WHERE {only}"


def collapsed(d: Dialect, files: str, rules: list[tuple] | None = None) -> str:
    """Findings of one family within eight lines are one, told by the first rule; variants are counted."""
    rules = R.RULES if rules is None else rules
    family = "CASE rule_no " + " ".join(f"WHEN {i} THEN '{r[5]}'" for i, r in enumerate(rules) if r[5]) + " ELSE concat(rule_id, ':', CAST(line_no AS VARCHAR(12))) END"
    keyed = f"(SELECT *, {family} AS family, CAST(FLOOR(line_no / {d.num(8.0)}) AS INT) AS block FROM ({findings(d, files, rules)}) f)"
    w = "PARTITION BY doc_id, family, block"
    return f"SELECT doc_id, rule_id, severity, category, line_no, family, CAST(n - 1 AS BIGINT) AS variants FROM (SELECT *, ROW_NUMBER() OVER ({w} ORDER BY rule_no, line_no) AS place, COUNT(*) OVER ({w}) AS n FROM {keyed} k) x WHERE place = 1"


def content_hits(d: Dialect, lines: str) -> str:
    """Content rules on lines of prose."""
    parts = [f"SELECT doc_id, line_no, '{r}' AS rule_id, '{s}' AS severity, CAST({d.size(d.extract_all('raw', p, 0, f))} AS BIGINT) AS n FROM hit_lines WHERE {d.match('raw', p, f)}" for r, p, f, s in R.CONTENT_RULES]
    some = d.any("raw", [(p, f) for _, p, f, _ in R.CONTENT_RULES])
    return f"WITH hit_lines AS (SELECT doc_id, line_no, raw FROM {lines} l WHERE {some}) " + " UNION ALL ".join(parts)


def content_scores(d: Dialect, lines: str) -> str:
    """A document's hits by severity, and 100 less a penalty for each kind of hit and its repeats."""
    weight = {"high": 20, "medium": 10, "low": 4}
    count = {r: d.size(d.extract_all("raw", p, 0, f)) for r, p, f, _ in R.CONTENT_RULES}
    sums = f"(SELECT doc_id, CAST(COUNT(*) AS BIGINT) AS n_lines, {', '.join(f'CAST(SUM({c}) AS BIGINT) AS n{i}' for i, c in enumerate(count.values()))} FROM {lines} l GROUP BY doc_id)"
    total = lambda s: "(" + " + ".join(f"n{i}" for i, r in enumerate(R.CONTENT_RULES) if r[3] == s) + ")"
    penalty = " + ".join(f"CASE WHEN n{i} > 0 THEN {weight[r[3]]} + LEAST(10, n{i} - 1) ELSE 0 END" for i, r in enumerate(R.CONTENT_RULES))
    found = d.labels([(f"n{i} > 0", r[0]) for i, r in enumerate(R.CONTENT_RULES)])
    return f"SELECT doc_id, n_lines, {total('high')} AS high, {total('medium')} AS medium, {total('low')} AS low, {found} AS rules, GREATEST(0, 100 - ({penalty})) AS score FROM {sums} s"
