"""What operators mean, on rows small enough to check by hand; the oracle shares their text, so it can't."""

import pytest

from gridwarden.functions.dialect import SPARK, not_starting
from gridwarden.functions.run import apply
from gridwarden.functions.tables import written
from gridwarden.operators import cluster, compare, flow, govern, history, lines, rules, scan, score, suppress, system, taint
from gridwarden.operators.taint import close

FIELDS = (
    "doc_id long, seq int, type string, severity string, category string, title string, explanation string, line int, confidence double, exploit_verified boolean, exploit_chain string,"
    " exploit_payload string, fix string, fix_rejection_reason string, reachability int, sink_reachable boolean, blocked_at string, code string"
)


def issue(seq, title="t", explanation="e", **other):
    row = {"doc_id": 1, "seq": seq, "type": "bug", "severity": "high", "category": "security", "title": title, "explanation": explanation, "line": 1, "code": "x"} | other
    return tuple(row.get(f.split()[0]) for f in FIELDS.split(", "))


@pytest.fixture
def cases(spark):
    return lambda *rows: spark.createDataFrame(list(rows), FIELDS)


@pytest.fixture
def source(spark):
    def make(*codes):
        return apply(lines.parse, files=spark.createDataFrame([(i + 1, c) for i, c in enumerate(codes)], "doc_id long, code string"))

    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_lines_carry_the_file_marker(source):
    got = rows(source("a\n// file: x.js\n\tb \n\nfilename: y.py\n  // c\n'd'"), "line_no", "trimmed", "indent", "is_comment", "is_string", "file")
    assert got == [(1, "a", 0, False, False, "<input>"), (2, "// file: x.js", 0, True, False, "x.js"), (3, "b", 1, False, False, "x.js"), (4, "", 0, False, False, "x.js"), (5, "filename: y.py", 0, False, False, "y.py"), (6, "// c", 2, True, False, "y.py"), (7, "'d'", 0, False, True, "y.py")]


def test_last_definition_wins_and_calls_know_their_caller(source):
    text = source("function a(x) {}\nfunction b() {\n  a(1); c(2); a(3)\n}\nconst a = async (y) => b()\ndef f(p):\nclass K:\n  a(4)")
    assert rows(apply(lines.nodes, lines=text), "name", "line_no", "kind", "is_async") == [("K", 7, "class", False), ("a", 5, "arrow", True), ("b", 2, "function", False), ("f", 6, "def", False)]
    # the first a is not a definition any more, and `a(x)` on its line is a call
    assert rows(apply(lines.calls, lines=text), "line_no", "caller", "callee", "args") == [(1, "__global__", "a", "x"), (2, "b", "b", ""), (3, "b", "a", "1"), (3, "b", "a", "3"), (5, "a", "b", ""), (6, "f", "f", "p"), (8, "K", "a", "4")]


def test_dead_lines(source):
    text = source("MODE = 'off'\nif MODE == 'on':\n  a\n    b\nc\nreturn x\n  d\ne\nif (false) {\n  f\n}\nif (true) {\n  g\n}")
    assert [r[0] for r in rows(apply(lines.dead, lines=text), "line_no")] == [10, 3, 4, 7]


def test_control_flow(source):
    text = source("if a:\n  b\nreturn c")
    assert rows(apply(lines.flow_edges, lines=text), "src", "dst", "kind") == [(0, 1, "next"), (1, 2, "true"), (1, 3, "false"), (2, 3, "next"), (3, -1, "next")]


def test_versions_follow_the_first_defined_name(source):
    text = source("const a = 1;\nconst b = a + 2\na = b * a\nlet { c, d } = b;\nfor x in a:")
    got = rows(apply(lines.versions, lines=text), "line_no", "name", "version", "depends_on")
    assert got == [(1, "a", 1, None), (2, "b", 1, "a_1"), (3, "a", 2, "a_1"), (4, "c", 1, "b_1"), (4, "d", 1, "b_1"), (5, "x", 1, "a_2")]


def test_path_facts_protect_to_the_dedent(source):
    text = source("def f():\n    if not allowed(x):\n        y = html.escape(x)\n        z\n    w\nv")
    got = {r[0]: r[1:] for r in rows(apply(lines.path_facts, lines=text), "line_no", "sanitizers", "protects_until")}
    assert got[3] == ("html", 5)


def test_reachability_by_the_nearest_guard(source):
    text = source("requireAuth(x)\n" + "a\n" * 40 + "b\n" + "c\n" * 20 + "if (false) {")
    got = {r[0]: r[1:] for r in rows(apply(lines.reachability, lines=text), "line_no", "attacker", "reach_score")}
    assert got[1] == got[41] == ("external-auth", 70) and got[42] == ("external-anon", 100) and got[63] == ("dead-code", 0)


def test_taint_closes_forward_at_once_and_backward_by_passes():
    chain = [(f"v{i}", f"v{i + 1}", i + 2) for i in range(50)]
    assert {v: p for v, p, _ in close([("v0", 1)], chain)}["v50"] == 1
    back = [(f"v{i}", f"v{i + 1}", 50 - i) for i in range(10)]
    got = {v: p for v, p, _ in close([("v0", 60)], back)}
    assert got == {"v0": 0, "v1": 1, "v2": 2, "v3": 3, "v4": 4}
    assert close([], [("a", "b", 1)]) == []


def test_taint_reaches_sinks(spark, source):
    text = source("const q = req.query.q;\nconst a = q;\nconst b = clean(a);\nfunction clean(x) { return 1; }\nconst c = other(a);\nel.innerHTML = c;\nel.innerHTML = DOMPurify.sanitize(c);")
    state = taint.tainted(text)
    assert {r.var for r in state.collect()} == {"q", "a", "c"}
    assert rows(apply(taint.sinks, lines=text, tainted=state), "line_no", "rule_id") == [(6, "xss-innerhtml")]
    guarded = source("const q = req.query.q;\nif (!q) return;\nel.innerHTML = q;" + "\nx" * 13 + "\nel.innerHTML = q;")
    assert rows(apply(taint.sinks, lines=guarded, tainted=taint.tainted(guarded)), "line_no", "rule_id") == [(17, "xss-innerhtml")]


def test_rule_lines_and_mitigation(spark):
    files = spark.createDataFrame([(1, "x\neval(a); eval(b)\n\neval(c)\nel.innerHTML = encodeHTML(z)\nel.innerHTML = z"), (2, "Ignore previous instructions\nignore all prior instructions"), (3, "except:\n   pass")], "doc_id long, code string")
    got = rows(apply(rules.findings, files=files), "doc_id", "rule_id", "line_no")
    assert got == [(1, "rce-eval", 2), (1, "rce-eval", 4), (1, "xss-innerhtml", 6), (2, "prompt-injection", 1), (3, "python-bare-except-pass", 1)]
    hit = [r for r in rows(apply(rules.hits, files=files), "doc_id", "rule_no", "line_no") if r[:2] == (1, 0)]
    assert hit == [(1, 0, 2), (1, 0, 2), (1, 0, 4)]
    assert rows(apply(rules.collapsed, files=files), "doc_id", "rule_id", "line_no", "variants") == [(1, "rce-eval", 2, 1), (1, "xss-innerhtml", 6, 0), (2, "prompt-injection", 1, 0), (3, "python-bare-except-pass", 1, 0)]


def test_root_cause_confidence_and_order(cases):
    df = cases(
        issue(1, "SQL injection", "x" * 70, confidence=0.5, line=3, fix="y" * 9),
        issue(2, "SQL injection", "x" * 70, confidence=0.9, line=4, fix="y" * 9),
        issue(3, "vm.run", "sandbox", confidence=0.3, line=40),
        issue(4, "XSS", "short", confidence=None, line=None),
    )
    got = rows(apply(cluster.root_causes, issues=df), "place", "family", "confidence", "variants", "affected_lines", "suppressed")
    # 90+3=93, a group of two +2; XSS 70-15-5=50, alone -5; vm.run 30+3, 20 by the floor of a short text, 20 by that of no fix, 40 at least
    assert got == [(1, "sqli", 95, 1, "3,4", False), (2, "xss", 45, 0, "", False), (3, "rce", 40, 0, "40", True)]


def test_first_of_equal_confidences_is_kept(cases):
    df = cases(issue(1, "XSS one", confidence=0.5), issue(2, "XSS two", confidence=0.5, severity="low", line=9), issue(3, "XSS three", confidence=0.4, line=None))
    got = rows(apply(cluster.families, issues=df), "family", "severity", "title", "total", "lines", "sinks")
    assert got == [("xss", "high", "XSS one", 3, "1,9", "L1,L9,unknown sink")]


def test_decay_multiplies_trust_and_context(cases):
    code = "app.get('/x', requireAuth, (req, res) => {\n  box.innerHTML = DOMPurify.sanitize(v);\n});"
    (row,) = apply(score.decay, cases=cases(issue(1, confidence=0.8, line=2, code=code, exploit_verified=True))).collect()
    assert row.after == pytest.approx(80 * 0.1 * (0.6 * 1.3 * 1.5)) and row.suppressed and row.reason == "sanitized"
    assert row.sanitizers == "dompurify" and row.modifiers == "auth-required, public-route"
    (row,) = apply(score.decay, cases=cases(issue(1, confidence=0.8, line=1, code="if (false) { }"))).collect()
    assert row.after == 0 and row.reason == "dead code"


def test_not_starting_is_a_look_ahead():
    import re

    bare, ahead = re.compile("/" + not_starting(["internal", "admin", "ad"]).replace(r"\z", r"\Z")), re.compile("/(?!internal|admin|ad)")
    for text in ("/internal", "/interna", "/int", "/", "/admin", "/adm", "/a", "/b", "/x/admin", "/admin/internal", "/admin/i"):
        assert bool(bare.search(text)) == bool(ahead.search(text)), text


def test_bayes_clamps_after_each_step(cases):
    (row,) = apply(score.bayes, cases=cases(issue(1, "SQL injection", line=1, code="db.query(req.body.x)", exploit_verified=True))).collect()
    # .55 x3 -> .97, x1.6 -> .97, x1.5 -> .97, AI only x.6
    assert row.posterior == pytest.approx(0.97 * 0.6) and row.new_severity == "medium" and row.change == "down"


def test_firewall_drops_what_the_line_does_not_show(cases):
    code = "// note\nel.innerHTML = req.body.x\n"
    got = rows(apply(suppress.firewall, cases=cases(
        issue(1, "XSS in page", "x" * 30, line=2, code=code), issue(2, "XSS in page", "x" * 30, line=1, code=code), issue(3, "XSS in page", "x" * 30, line=9, code=code, severity="low"), issue(4, "A title", "x" * 30, type="suggestion", code=code, line=2),
    )), "seq", "action", "confidence")
    assert got == [(1, "pass", 0.75), (2, "drop", pytest.approx(0.3)), (3, "pass", pytest.approx(0.3)), (4, "downgrade", 0.75)]


def test_contradictions_within_five_lines(cases):
    df = cases(issue(1, "fine", "a prepared statement", line=10), issue(2, "SQL injection", line=15), issue(3, "SQL injection", line=16), issue(4, "SQL injection", line=None), issue(5, "fine", "textContent", line=None))
    assert rows(apply(suppress.contradictions, issues=df), "a", "b") == [(1, 2), (4, 5)]


def test_policy_priority_and_gate(cases):
    df = cases(issue(1, category="sql", confidence=0.1), issue(2, severity="low", category="idor", confidence=0.1), issue(3, severity="medium", confidence=0.1), issue(4, severity="low", confidence=0.9, exploit_verified=True))
    got = rows(apply(suppress.policy, issues=df), "seq", "action", "severity", "blocked")
    assert got == [(1, "require-fix", "high", True), (2, "escalate", "medium", False), (3, "suppress", "medium", False), (4, "escalate", "medium", False)]
    (gate,) = apply(suppress.gate, issues=df).collect()
    assert not gate.gate_pass and gate.n_blocked == 1 and gate.reasons == "t"


def test_delta(spark, cases):
    now, then = cases(issue(1, "A new one"), issue(2, "Same"), issue(3, "Back again", severity="low")), cases(issue(1, "Same"), issue(2, "Gone"), issue(3, "Back again"))
    got = rows(apply(compare.delta, current=now, baseline=then), "title", "status")
    assert got == [("A new one", "new"), ("Back again", "regression"), ("Back again", "resolved"), ("Gone", "resolved")]


def test_rates_of_nothing(spark):
    df = spark.createDataFrame([("a", "TN"), ("b", "FN")], "vuln_class string, outcome string")
    got = {r.vuln_class: r for r in apply(compare.confusion, results=df).collect()}
    assert (got["a"].precision_, got["a"].recall_, got["a"].f1, got["a"].fp_rate) == (1, 1, 1, 0) and got["b"].recall_ == 0 and got["all"].accuracy == 0.5


def test_memory_counts_absences(spark):
    memory = spark.createDataFrame([(1, "a", 2, 0, True, False), (1, "b", 1, 2, False, False), (1, "c", 4, 5, False, True), (2, "a", 1, 0, False, False)], "repo long, key string, seen_count long, absent_scans long, confirmed_fp boolean, suppressed boolean")
    scan = spark.createDataFrame([(1, "a", "low", 1), (1, "d", "high", 3)], "repo long, key string, severity string, n long")
    got = rows(apply(history.remember, memory=memory, scan=scan), "repo", "key", "status", "seen_count", "absent_scans", "escalated")
    assert got == [(1, "a", "suppressed", 3, 0, False), (1, "b", "resolved", 1, 3, False), (1, "c", "resolved", 4, 5, False), (1, "d", "recurring", 3, 0, True)]


def test_drift_uses_the_last_samples(spark):
    data = [("a", 0.1 * (i % 2), i, 1) for i in range(30)] + [("b", 0.9 if i < 5 else 0.2 + 0.0 * i, i, 1) for i in range(25)] + [("c", float(i) / 5, i, 1) for i in range(3)] + [("d", None, 1, 1)]
    df = spark.createDataFrame([(k, c, s, p) for k, c, s, p in data], "key string, confidence double, scan long, pos long")
    got = {r.key: (r.n, r.label) for r in apply(history.drift, scans=df).collect()}
    assert got == {"a": (20, "stable"), "b": (20, "stable"), "c": (3, "escalating"), "d": (1, "stable")}


def test_attack_chain_needs_its_escalation(cases):
    got = rows(apply(system.chains, issues=cases(issue(1, "command injection here", confidence=0.5), issue(2, "jwt bypass"))), "title", "severity", "likelihood")
    assert ("Command Injection → RCE", "critical", 35) in got
    assert rows(apply(system.chains, issues=cases(issue(1, "open redirect"))), "title") == []


def test_sql_literals_survive_both_dialects(spark):
    text = "it's \"${x}\" \\d \n{0,3}"
    assert spark.sql("SELECT " + SPARK.text(text).replace("{", "{")).first()[0] == text


def flow_of(text):
    flagged = apply(flow.flagged, lines=text)
    return {"lines": flagged, "tainted": flow.tainted(flagged)}


def test_flow_follows_aliases_and_leaves_dead_lines_out(source):
    text = source("function f(req) {\n  const id = req.query.id;\n  const key = id;\n  const again = key;\n  db.query(again);\n  if (false) {\n    db.query(again);\n  }\n}")
    given = flow_of(text)
    assert rows(given["tainted"], "var", "pass_no", "line_no", "hops") == [("again", 1, 4, 2), ("id", 0, 2, 0), ("key", 1, 3, 1)]
    (row,) = apply(flow.sink_findings, **given).collect()
    # 95 less 8 a hop; 85 less 4 a hop
    assert (row.line_no, row.sink, row.var, row.cwe, row.reachability, row.exploitability, row.confidence) == (5, "sql", "again", "CWE-89", 79, 88, 77)


def test_flow_names_in_the_argument_count_first(source):
    text = source("const id = req.query.id;\nconst other = req.query.other;\nconst x = other + db.query(id);\nlog(other); fetch(target);")
    got = rows(apply(flow.sink_findings, **flow_of(text)), "line_no", "sink", "var")
    assert got == [(3, "sql", "id"), (4, "ssrf", "other")]


def test_flow_through_constructor_fields(source):
    text = source("class Store:\n    def __init__(self, limit, root):\n        self.root = root\n        self.limit = limit\n\nname = request.args.get('name')\nstore = Store(3, name)\nopen(store.root)\nopen(store.limit)")
    given = flow_of(text)
    assert ("store.root", 1) in rows(given["tainted"], "var", "hops") and "store.limit" not in {r.var for r in given["tainted"].collect()}


def test_flow_lists_of_arguments_are_options(source):
    text = source("host = request.args.get('host')\nsubprocess.run(['ping', shlex.quote('x'), host], shell=False)\n")
    got = rows(apply(flow.sink_findings, **flow_of(text)), "sink", "cwe", "exploitability", "confidence", "blast_radius")
    assert got == [("cmd", "CWE-88", 45, 62, "medium")]


def test_flow_in_pages_and_requests(source):
    text = source("const a = req.query.a;\nel.innerHTML = a;\nel.innerHTML = DOMPurify.sanitize(a);\nreturn (<div dangerouslySetInnerHTML={{ __html: a }} />);\nfetch(a);\nx\nx\nx\nx\nx\nx\n// ALLOWED_HOSTS\nfetch(a);")
    given = flow_of(text)
    assert rows(apply(flow.page_findings, **given), "line_no", "context") == [(2, "dom-sink"), (4, "jsx")]
    assert rows(apply(flow.request_findings, **given), "line_no", "kind") == [(5, "direct")]


def test_block_ends_are_the_next_row_no_deeper(spark):
    import random

    random.seed(1)
    data = [(doc, n, random.randint(0, 4)) for doc in range(6) for n in range(1, 60)]
    starts = [x for x in data if random.random() < 0.5]
    schema = "doc_id long, line_no int, indent int"
    for strict in (False, True):
        ends = lambda d, starts, every: lines._ends(d, starts, every, strict)[1:-1]  # noqa: B023, E731
        got = rows(apply(ends, starts=spark.createDataFrame(starts, schema), every=spark.createDataFrame(data, schema)), "doc_id", "line_no", "until")
        want = [(a, n, min((m for b, m, j in data if a == b and m > n and (j < i or j == i and not strict)), default=None)) for a, n, i in starts]
        assert got == sorted(want, key=repr)


def test_timelines_end_with_the_last_scan_of_their_repository(spark):
    data = [(1, "1/a", "high", 1, 1), (1, "1/a", "low", 2, 1), (1, "1/b", "low", 1, 2), (2, "2/a", "medium", 1, 1), (2, "2/a", "low", 5, 2), (2, "2/c", "low", 5, 1)]
    got = rows(apply(history.timelines, scans=spark.createDataFrame(data, "repo long, key string, severity string, scan long, pos long")), "repo", "key", "severity", "first_seen", "last_seen", "seen_count", "status", "resolved_at")
    assert got == [(1, "1/a", "high", 1, 2, 2, "active", None), (1, "1/b", "low", 1, 1, 1, "resolved", 2), (2, "2/a", "medium", 1, 5, 2, "active", None), (2, "2/c", "low", 5, 5, 1, "active", None)]


def test_whole_scan_keeps_the_first_of_a_line_and_judges_it(spark):
    files = spark.createDataFrame([(1, "function f(req) {\n  const id = req.query.id;\n  const q = id + ' more';\n  db.query(q);\n  eval(id);\n}"), (2, "const a = 1;\n")], "doc_id long, code string")
    flagged = apply(flow.flagged, lines=apply(lines.parse, files=files))
    found = written(apply(scan.findings, files=files, lines=flagged, tainted=flow.tainted(flagged)), "found")
    got = rows(found.where("line = 4"), "doc_id", "title", "exploit_chain")
    assert (1, "CWE-89 q sql", "outside input -> q -> line 4 -> sql") in got
    assert {r.doc_id for r in found.collect()} == {1} and found.select("seq").distinct().count() == found.count()
    (verdict,) = apply(scan.verdicts, found=found).collect()
    # the rule on eval has no chain, so it is no severe bug; those that flow from the query are
    assert verdict.findings == found.count() and 0 < verdict.proven < verdict.findings and not verdict.gate_pass


def test_lines_of_many_hits_in_one_file(spark):
    code = "\n".join(f"x{i}\neval(a{i})" for i in range(3000))
    got = apply(rules.findings, files=spark.createDataFrame([(1, code)], "doc_id long, code string")).where("rule_id = 'rce-eval'")
    assert sorted(r.line_no for r in got.collect()) == [2 * i + 2 for i in range(3000)]


def test_downstream_goes_any_way_and_round_circles(spark):
    starts = spark.createDataFrame([(1, "a"), (2, "x")], "doc_id long, node string")
    chain = [(2, f"n{i}", f"n{i + 1}") for i in range(40)]
    steps = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "a", "c"), (1, "q", "r"), (2, "x", "n0"), *chain], "doc_id long, src string, dst string")
    got = rows(system.downstream(starts, steps), "doc_id", "node", "hops")
    assert [r for r in got if r[0] == 1] == [(1, "b", 1), (1, "c", 1)] and (2, "n40", 41) in got


def test_two_step_chains_need_order(spark, cases):
    text = lambda t: {"title": t, "explanation": "", "category": "security"}
    given = cases(issue(1, **text("auth bypass")), issue(2, **text("ssrf"), confidence=0.5), issue(3, **text("ssrf")), issue(4, **text("sql injection"), confidence=1.0), issue(5, **text("sql injection")))
    got = rows(apply(system.two_step_chains, issues=given), "first_seq", "second_seq", "title", "likelihood")
    assert got == [(2, 4, "SSRF → Internal Network → SQLi → Database Access", 53)]


def test_confidence_is_capped(cases):
    given = cases(issue(1, confidence=0.99), issue(2, confidence=0.99, category="logic"), issue(3, confidence=-1.0), issue(4, confidence=0.999, type="risk"), issue(5, type="suggestion", confidence=0.714), issue(6), issue(7, type="suggestion", confidence=0.444))
    assert rows(apply(govern.capped, issues=given), "seq", "confidence_pct") == [(1, 95), (2, 90), (3, 0), (4, 80), (5, 70), (6, None), (7, 44)]


def test_verdict_of_code_goes_first(spark):
    given = spark.createDataFrame([(1, 1, "flag", "suppress", 0.1), (1, 2, "neutral", "suppress", 0.9), (1, 3, None, "flag", 0.5)], "doc_id long, seq int, by_code string, by_model string, confidence double")
    assert rows(apply(govern.backed, verdicts=given), "seq", "verdict", "confidence", "source") == [(1, "flag", 1.0, "deterministic"), (2, "suppress", 0.7, "ai"), (3, "flag", 0.5, "ai")]


def test_approvals_of_the_repository_that_are_in_force(spark):
    found = spark.createDataFrame([("r", 1, 1, "SQL in Login", "x"), ("r", 1, 2, "XSS", "Trusted code"), ("s", 2, 1, "SQL in Login", "trusted"), ("r", 1, 3, "other", None)], "repo string, doc_id long, seq int, title string, explanation string")
    given = spark.createDataFrame([("r", 2, "trust", "trusted", "ours", 5), ("r", 1, "title", "sql*login", "seen", 200), ("r", 0, "title", "xss", "old", 5)], "repo string, pos int, kind string, pattern string, reason string, expires_at long")
    got = apply(lambda d, issues, approvals: govern.approved(d, issues, approvals, "100"), issues=found, approvals=given)
    assert rows(got, "doc_id", "seq", "kind", "reason") == [(1, 1, "title", "seen"), (1, 2, "trust", "ours")]


def fnv(text):
    h = 0x811C9DC5
    for c in text:
        h ^= ord(c)
        h = int(float(h - 2**32 if h >= 2**31 else h) * 16777619.0) % 2**32
    return f"{h:08x}"


def test_fingerprints(spark):
    files = spark.createDataFrame([(1, "no import"), (2, "import {a} from 'x'"), (3, "import 'é0' \n import { b }c'"), (4, "\n".join(f"import 'm{i}'" for i in range(12)))], "doc_id long, code string")
    want = ["", "import {a} from '", "|".join(["import 'é0'", "import { b }c'"]), "|".join(f"import 'm{i}'" for i in range(10))]
    assert rows(apply(govern.fingerprints, files=files), "doc_id", "fingerprint") == [(i + 1, fnv(w)) for i, w in enumerate(want)]


def test_own_rules_follow_title_and_path(spark, cases):
    given = cases(issue(1, "SQL in x", confidence=0.9), issue(2, "odd", confidence=0.9), issue(3, "SQL", confidence=0.9)).selectExpr("*", "CASE seq WHEN 3 THEN 'tests/a.js' ELSE 'src/a.js' END AS path")
    own = [("custom", "t", None, None, None, None, "suppress", None, None, None, "^tests/"), ("custom", "s", None, None, None, None, "require-fix", "n", None, "sql", "^src/")]
    got = apply(lambda d, issues: suppress.policy(d, issues, [], custom=own), issues=given)
    assert rows(got, "seq", "rules", "action", "blocked") == [(1, "s", "require-fix", True), (2, "", None, False), (3, "t", "suppress", False)]


def test_firewall_takes_copies_and_contradicted_findings(spark, cases):
    from gridwarden.operators import documents

    proof = {"exploit_chain": "from here to there and further on"}
    given = cases(
        issue(1, "SQL injection via x", line=10, **proof), issue(2, "SQL injection in y", line=12, **proof), issue(3, "SQL injection", line=14, **proof), issue(4, "Odd", line=50), issue(5, "Odd", severity="low", line=90),
    )
    assert rows(documents.firewall(given), "seq", "passed", "severity", "type") == [(1, True, "high", "bug"), (3, True, "high", "bug"), (4, False, "medium", "risk"), (5, True, "low", "bug")]


def test_language_profiles_and_semantic_findings(spark):
    from gridwarden.operators import verify

    files = spark.createDataFrame([(1, "def f(x):\n    a = request.args['q']\n    b = input()\n    return json.loads(b)\n"), (2, "nothing")], "doc_id long, code string")
    assert rows(apply(verify.language_profiles, files=files), "doc_id", "language", "n_sources", "n_safe") == [(1, "python", 2, 1), (2, "unknown", 0, 0)]
    code = "app.get('/x', (req, res) => {\n  eval(req.query.q)\n})"
    files = spark.createDataFrame([(1, code), (2, code + "\nrequireAuth()")], "doc_id long, code string")
    routes = apply(verify.semantic_routes, lines=apply(lines.parse, files=files))
    got = rows(apply(verify.semantic_findings, files=files, routes=routes), "doc_id", "place", "line", "confidence", "title")
    assert got[:3] == [(1, 1, 1, 0.82, "Auth gap: /x"), (1, 2, None, 0.7, "Chain: auth-bypass-1"), (1, 3, None, 0.7, "Chain: cross-module-taint-main")]
    assert all(r[4] != "Chain: cross-module-taint-main" for r in got if r[0] == 2)
