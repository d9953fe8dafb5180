"""Labelled code, model answers and findings to run operators on, derived from the driver's tables.

The tables hold prose, not code. So every order stands for a source file, one of CODE in turn, and every line item
for a finding in it, its fields by arithmetic on the row. Both are SQL, the same in any engine.
"""

from __future__ import annotations

from ..functions.dialect import SPARK, Dialect
from ..functions.run import PLACED

#: id, class, should a scan flag it, severity, language, code
CODE = [
    ("JS-SQL-1", "sqli", True, "high", "javascript", "const express = require('express');\nconst app = express();\napp.get('/people', (req, res) => {\n  const who = req.query.who;\n  const sql = \"SELECT * FROM people WHERE name = '\" + who;\n  db.query(sql, (err, rows) => res.json(rows));\n});\n"),
    ("JS-SQL-2", "sqli", True, "high", "javascript", "// file: src/orders.js\nasync function orders(req) {\n  const { id } = req.params;\n  const key = id;\n  return db.query(`SELECT * FROM orders WHERE id = ${key}`);\n}\nmodule.exports = { orders };"),
    ("JS-SQL-SAFE", "sqli", False, "high", "javascript", "async function order(req) {\n  const id = parseInt(req.params.id, 10);\n  return db.query('SELECT * FROM orders WHERE id = ?', [id]);\n}\n"),
    ("JS-XSS-1", "xss", True, "high", "javascript", "function show(req) {\n  const note = req.body.note;\n  const box = document.getElementById('box');\n  box.innerHTML = note;\n}\nif (false) {\n  box.innerHTML = other;\n}"),
    ("JS-XSS-SAFE", "xss", False, "high", "javascript", "import React from 'react';\nfunction show(note) {\n  box.textContent = note;\n  return DOMPurify.sanitize(note, { ALLOWED_TAGS: [] });\n}"),
    ("JS-CMD-1", "cmd", True, "high", "javascript", "const cp = require('child_process');\nrouter.post('/run', function run(req, res) {\n  const target = req.body.host;\n  exec(`ping -c 1 ${target}`, (e, out) => res.send(out));\n});"),
    ("JS-CMD-SAFE", "cmd", False, "high", "javascript", "router.post('/run', requireAuth, function run(req, res) {\n  const target = allowlist[req.body.host];\n  spawn('ping', ['-c', '1', target], { shell: false });\n});"),
    ("JS-SSRF-1", "ssrf", True, "high", "javascript", "export async function GET(req) {\n  const url = req.nextUrl.searchParams.get('url');\n  const answer = await fetch(url);\n  return answer.text();\n}"),
    ("JS-SSRF-SAFE", "ssrf", False, "medium", "javascript", "const ALLOWED_HOSTS = ['api.example.com'];\nexport async function POST(req) {\n  const url = new URL(req.body.url);\n  if (!ALLOWED_HOSTS.includes(url.hostname)) throw new Error('401 unauthorized');\n  return fetch(url);\n}"),
    ("JS-PATH-1", "path", True, "high", "javascript", "app.use('/files', (req, res) => {\n  const name = req.query.name;\n  const full = path.join(__dirname, name);\n  fs.readFile(full, (e, d) => res.end(d));\n});\nfunction internalOnly() { return 1; }"),
    ("JS-PROTO-1", "proto", True, "high", "javascript", "function merge(target, source) {\n  for (let key in source) {\n    if (key !== '__proto__') {\n      target[key] = source[key];\n    }\n  }\n  return target;\n}\nmerge({}, JSON.parse(req.body.patch));"),
    ("JS-PROTO-SAFE", "proto", False, "high", "javascript", "function merge(target, source) {\n  Object.keys(source).forEach(key => {\n    if (['__proto__', 'constructor', 'prototype'].includes(key)) return;\n    target[key] = source[key];\n  });\n  return Object.freeze(target);\n}"),
    ("JS-EVAL-1", "cmd", True, "high", "javascript", "app.post('/calc', (req, res) => {\n  const code = req.body.code;\n  const out = eval(code);\n  const make = new Function(code);\n  res.send({ out, env: process.env });\n});"),
    ("JS-REDIR-1", "redirect", True, "high", "javascript", "app.get('/go', (req, res) => {\n  const next = req.query.next;\n  res.setHeader('X-Next', req.query.next);\n  res.redirect(next);\n});"),
    ("JS-JWT-1", "auth", True, "high", "javascript", "const jwt = require('jsonwebtoken');\nfunction who(req) {\n  const token = req.headers.authorization;\n  const user = jwt.decode(token);\n  if (user.role === 'admin') return user;\n  if (token === secret) return user;\n}"),
    ("JS-JWT-SAFE", "auth", False, "medium", "typescript", "import { verify } from 'jsonwebtoken';\nexport function who(token: string) {\n  return jwt.verify(token, process.env.JWT_SECRET, { algorithms: ['HS256'] });\n}\nconst same = crypto.timingSafeEqual(a, b);"),
    ("PY-SQL-1", "sqli", True, "high", "python", "from flask import Flask, request\napp = Flask(__name__)\n\n@app.route('/user')\ndef user():\n    user_id = request.args.get('user_id')\n    query = f\"SELECT * FROM users WHERE id = {user_id}\"\n    cursor.execute(query)\n    return str(cursor.fetchall())\n"),
    ("PY-SQL-SAFE", "sqli", False, "high", "python", "@login_required\ndef user(request):\n    user_id = int(request.GET.get('user_id'))\n    cursor.execute('SELECT * FROM users WHERE id = %s', (user_id,))\n    return JsonResponse({'ok': True})\n"),
    ("PY-CMD-1", "cmd", True, "high", "python", "import os, subprocess\n\ndef run(cmd):\n    os.system('echo ' + cmd)\n    subprocess.run(cmd, shell=True)\n    try:\n        pass\n    except Exception:\n        pass\n"),
    ("PY-CMD-SAFE", "cmd", False, "high", "python", "import shlex, subprocess\n\ndef run(cmd):\n    # TODO disabled\n    subprocess.run(['echo', shlex.quote(cmd)], shell=False)\n"),
    ("PY-SECRET-1", "auth", True, "high", "python", "SECRET_KEY = 'not-a-real-secret-value'\nPASSWORD = 'hunter2hunter2'\n\ndef login(username, password):\n    if username == 'admin':\n        return True\n    return password == PASSWORD\n"),
    ("PY-DIV-1", "logic", True, "medium", "python", "def mean(values):\n    total = sum(values)\n    return total / len(values)\n\ncache = {}\ndef get(key):\n    cache[key] = load(key)\n    return cache[key]\n"),
    ("PY-PICKLE-1", "deserialize", True, "high", "python", "import pickle\nfrom fastapi import FastAPI, Request\napp = FastAPI()\n\n@app.post('/admin/load')\nasync def load(data, session):\n    body = await request.json()\n    obj = pickle.loads(data)\n    return {'value': obj}\n"),
    ("PY-UP-1", "path", True, "high", "python", "class Store:\n    def __init__(self, root, limit=3):\n        self.root = root\n        self.limit = limit\n\n    def save(self, name):\n        path = os.path.join(self.root, name)\n        with open(path) as f:\n            return f.read()\n"),
    ("JS-EVENTS", "logic", False, "low", "javascript", "// file: bus.js\nbus.on('paid', handle);\nfunction pay(order) {\n  bus.emit('paid', order);\n  bus.emit('left', order);\n}\n// file: mail.js\nbus.on('left', mail);\nfunction handle(order) { pay(order); mail(order); }\nconst mail = async (order) => fetch('https://mail.example.com');"),
    ("JS-GUARD", "sqli", False, "medium", "javascript", "function find(req) {\n  const id = req.query.id;\n  if (!id) return null;\n  if (typeof id !== 'string') throw new Error('id');\n  const text = id + '!';\n  return db.query('SELECT name FROM t WHERE id = ' + id);\n}"),
    ("JS-TEST", "xss", False, "medium", "javascript", "describe('box', () => {\n  it('shows', () => {\n    box.innerHTML = '<b>x</b>';\n    expect(box).toBeTruthy();\n  });\n});"),
    ("JS-LOG-1", "ssrf", True, "high", "javascript", "app.get('/find', async (req, res) => {\n  const host = req.headers['x-host'];\n  logger.info('lookup ' + host);\n  const answer = await axios.get(host);\n  res.json(answer.data);\n});"),
    ("JS-IDOR-1", "idor", True, "high", "javascript", "router.get('/bills/:id', async (req, res) => {\n  const bill = await Bill.findById(req.params.id);\n  res.json(bill);\n});"),
    ("JS-ENV-1", "ssrf", True, "high", "javascript", "app.get('/debug', (req, res) => {\n  res.json({ ok: true, env: process.env });\n});"),
    ("JS-DESER-1", "deserialize", True, "high", "javascript", "const serialize = require('node-serialize');\napp.post('/state', (req, res) => {\n  const state = serialize.unserialize(req.body.state);\n  res.send(state.name);\n});"),
    ("JS-PATH-SAFE", "path", False, "high", "javascript", "function read(req) {\n  const full = path.resolve(BASE, req.query.name);\n  if (!full.startsWith(BASE)) throw new Error('403');\n  return fs.readFileSync(full);\n}"),
    ("JS-EVAL-SAFE", "cmd", False, "high", "javascript", "function calc(req) {\n  const table = { add: (a, b) => a + b };\n  const op = table[req.body.op];\n  if (!op) return null;\n  return op(Number(req.body.a), Number(req.body.b));\n}"),
    ("JS-REDIR-SAFE", "redirect", False, "high", "javascript", "app.get('/go', (req, res) => {\n  const next = req.query.next;\n  if (!ALLOWED_PATHS.includes(next)) return res.redirect('/');\n  res.redirect(next);\n});"),
    ("JS-DEAD", "sqli", False, "high", "javascript", "function old(req) {\n  if (false) {\n    db.query('SELECT * FROM t WHERE id = ' + req.query.id);\n  }\n  return 1;\n}"),
    ("PY-LEAK-1", "logic", True, "medium", "python", "def rows(name):\n    conn = sqlite3.connect('shop.db')\n    return conn.execute('SELECT 1').fetchall()\n"),
    ("PY-TIME-1", "auth", True, "high", "python", "def allowed(token, stored_token):\n    if token == stored_token:\n        return True\n    return False\n"),
    ("PY-AUTH-SAFE", "auth", False, "high", "python", "import hmac, os\n\ndef allowed(token):\n    stored = os.environ['TOKEN']\n    return hmac.compare_digest(token, stored)\n"),
    ("PY-PATH-2", "path", True, "high", "python", "@app.route('/file')\ndef file():\n    name = request.args.get('name')\n    return send_file('/srv/data/' + name)\n"),
]

#: title, explanation, category, chain, payload, fix
FINDINGS = [
    ("SQL Injection in login query at L5", "User input is put into a SQL query text by concatenation, so that the database runs what the attacker writes.", "security", "req.query.who -> sql -> db.query in people handler", "who=' OR '1'='1' --", "db.query('SELECT * FROM people WHERE name = ?', [who])"),
    ("sql.inject via template", "sqli: template literal reaches db.query", "security", None, None, "value.replace(/['\"]/g, '')"),
    ("XSS via innerHTML", "Cross-site scripting: a note from req.body is written to innerHTML without escaping, and scripts in it run in the page.", "security", "req.body.note -> note -> box.innerHTML", "<img src=x onerror=alert(1)>", "box.innerHTML = clean(note)"),
    ("Cross site scripting through dangerouslySetInnerHTML", "dom sink", "security", None, "<svg/onload=alert(1)>", "DOMPurify.sanitize(note)"),
    ("SSRF in fetch( url )", "Server-side request forgery: fetch of a url that the user controls reaches internal services and cloud metadata endpoints.", "security", "searchParams url -> fetch(url) -> answer text", "http://169.254.169.254/latest", None),
    ("Command injection in exec", "Shell command built from req.body.host; exec( runs it in a shell. A remote code execution is possible.", "security", "req.body.host -> target -> exec ping", "; id #", "spawn('ping', [target])"),
    ("Path traversal in readFile with user name", "A file name from the query is joined to a directory; fs.readFile reads any file of the host.", "security", None, "../../etc/passwd", "path.resolve(base, name)"),
    ("Prototype pollution in merge", "Only __proto__ is blocked; constructor.prototype is still open to the attacker, who changes every object.", "security", "JSON.parse body -> merge -> target", None, None),
    ("Open redirect through res.redirect", "res.redirect goes where the user says; unvalidated redirect to a foreign site.", "security", None, None, "res.redirect('/home')"),
    ("Header injection (CRLF)", "res.setHeader gets a raw query value; http response splitting is possible with CR and LF in it.", "security", None, "a%0d%0ab", None),
    ("JWT decode without verify", "jwt.decode accepts any token; the algorithm none passes and the session is forged by anyone.", "security", "authorization header -> jwt.decode -> role", None, "jwt.verify(token, key, { algorithms: ['HS256'] })"),
    ("Remote code execution by eval( user input )", "rce: eval of request code; vm.run is no sandbox either.", "security", "req.body.code -> eval( code ) -> process", "process.exit()", None),
    ("vm.runInNewContext is no sandbox", "vm.run of user code escapes by the prototype chain and reaches the process.", "security", None, None, "vm.runInContext(code)"),
    ("ReDoS: catastrophic backtracking", "A regex with nested quantifiers; redos by a long line of input.", "performance", None, None, None),
    ("Hardcoded secret in source", "Hardcoded secret key and password string in the repository; anyone with access reads the api key literal.", "security", None, None, "os.environ['SECRET_KEY']"),
    ("Insecure deserialization with pickle", "pickle.loads of request data runs code when it is loaded: deserialization of untrusted data.", "security", "data -> pickle.loads", None, None),
    ("Mass assignment of req.body", "Object.assign(user, req.body) lets the client set any field; mass assignment.", "security", None, None, "pick(req.body, ['name'])"),
    ("Timing attack in token compare", "token === secret is compared byte by byte; a timing attack tells the secret.", "security", None, None, "crypto.timingSafeEqual(a, b)"),
    ("Missing auth on admin route", "No auth on an admin endpoint: authentication bypass, unauthorized access to users; missing check of ownership.", "security", None, None, None),
    ("IDOR: object reference without ownership check", "Insecure direct object reference: order id from the request, no check of who owns it.", "idor", None, None, None),
    ("Verbose error with stack trace", "Information disclosure: debug info and stack trace are sent to the client.", "security", None, None, "res.status(500).send('error')"),
    ("Race condition in stock check (TOCTOU)", "Concurrent requests pass the check before the stock is reduced; double spend.", "logic", None, None, None),
    ("Parameterized query confirmed", "The query is a prepared statement with an array of params; cursor.execute(sql, (id,)) is safe.", "security", None, None, None),
    ("Weak crypto: MD5", "MD5 for passwords", "crypto", None, None, "JSON.stringify(a) === JSON.stringify(b)"),
    ("Unused", "dead variable", "maintainability", None, None, ""),
    ("Prompt injection: ignore previous instructions", "Text in the source says to ignore previous instructions; prompt injection of a reviewer.", "security", None, None, None),
    ("Division by zero in mean", "ZeroDivision: mean of an empty list divides by zero and the worker stops.", "logic", None, None, "return total / max(1, len(values))"),
    ("Resource leak: connection not closed", "A database connection is opened on each call and never closed.", "performance", None, None, "with sqlite3.connect(p) as conn:"),
]


def code_table(d: Dialect) -> str:
    return d.values(["k", "vector_id", "vuln_class", "should_flag", "vector_severity", "lang", "code"], [(i, *row) for i, row in enumerate(CODE)])


def finding_table(d: Dialect) -> str:
    return d.values(["k", "title", "explanation", "category", "chain", "payload", "fix_text"], [(i, *row) for i, row in enumerate(FINDINGS)])


def files(d: Dialect) -> str:
    """(doc_id, vector_id, vuln_class, should_flag, vector_severity, lang, code): a source file per order."""
    return f"(SELECT o.o_orderkey AS doc_id, c.vector_id, c.vuln_class, c.should_flag, c.vector_severity, c.lang, c.code FROM {d.table('orders')} o JOIN {code_table(d)} c ON o.o_orderkey % {len(CODE)} = c.k)"


def issues(d: Dialect) -> str:
    """A finding per line item, with every field that a finding may have; nulls where one may be missing."""
    p, s = "l.l_partkey", "l.l_suppkey"
    order = "l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate"
    kind = f"({p} + 3 * {s} + l.l_linenumber) % {len(FINDINGS)}"
    place = f"CAST(ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY {order}) AS INT)"
    rows = d.table("lineitem")
    if d is SPARK:
        # line items are numbered, those that have a finding, before they get its texts: these are not sent along, and rows stay dealt out by doc_id
        rows, place = f"(SELECT l.*, {place} AS place FROM {rows} l WHERE {kind} >= 0)", "l.place"
    return f"""(SELECT l.l_orderkey AS doc_id, {place} AS seq,
      CASE {s} % 5 WHEN 3 THEN 'risk' WHEN 4 THEN 'suggestion' ELSE 'bug' END AS type,
      CASE {p} % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
      f.category, f.title, f.explanation,
      CAST(CASE WHEN {p} % 11 = 0 THEN NULL ELSE 1 + ({p} * 7 + l.l_linenumber * 3) % 12 END AS INT) AS line,
      CASE WHEN {s} % 7 = 0 THEN NULL ELSE CAST({p} % 101 AS DOUBLE) / 100 END AS confidence,
      CASE {p} % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS exploit_verified,
      CASE WHEN ({p} + {s}) % 3 > 0 THEN f.chain END AS exploit_chain,
      CASE WHEN ({p} + {s}) % 4 > 0 THEN f.payload END AS exploit_payload,
      CASE WHEN {p} % 3 > 0 THEN f.fix_text END AS fix,
      CASE WHEN {p} % 6 = 0 THEN 'no safe fix' END AS fix_rejection_reason,
      CAST(CASE WHEN {p} % 4 = 3 THEN NULL ELSE ({p} * 3) % 101 END AS INT) AS reachability,
      CASE ({p} + l.l_linenumber) % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS sink_reachable,
      CASE WHEN ({p} + l.l_linenumber) % 12 = 1 THEN 'schema check' END AS blocked_at
      FROM {rows} l JOIN {finding_table(d)} f ON {kind} = f.k)"""


def cases(d: Dialect) -> str:
    """Findings with the code that they are about."""
    return f"(SELECT i.*, c.code FROM {issues(d)} i JOIN {code_table(d)} c ON i.doc_id % {len(CODE)} = c.k)"


def votes_place(d: Dialect) -> str:
    """The column that tells where an answer stands in the table; none in DuckDB, whose rows come in that order on one thread."""
    return "row_place" if d is SPARK else ""


def votes(d: Dialect) -> str:
    """Answers of reviewing roles about a finding's title, as data. A role may answer twice at one pos: the answer that stands first in the table is the one that counts."""
    p = "l.l_partkey"
    rows, place = (d.table("lineitem" + PLACED), f", l.{votes_place(d)}") if votes_place(d) else (d.table("lineitem"), "")
    return f"""(SELECT l.l_orderkey AS doc_id, f.title, CAST(l.l_linenumber AS INT) AS pos,
      CASE {p} % 4 WHEN 0 THEN 'analyzer' WHEN 1 THEN 'critic' WHEN 2 THEN 'verifier' ELSE 'fix' END AS role,
      CASE l.l_suppkey % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'uncertain' END AS vote,
      l.l_suppkey % 2 = 0 AS exploit_verified, l.l_suppkey % 3 = 0 AS sink_reachable,
      CASE l.l_suppkey % 3 WHEN 0 THEN 'valid' WHEN 1 THEN 'bypassable' ELSE 'none' END AS fix_vote,
      CASE WHEN {p} % 7 = 0 THEN CAST({p} % 101 AS INT) END AS judge_score, {p} % 14 = 0 AS judge_escalate{place}
      FROM {rows} l JOIN {finding_table(d)} f ON ({p} + 3 * l.l_suppkey + l.l_linenumber) % {len(FINDINGS)} = f.k)"""


def scans(d: Dialect) -> str:
    """Findings over scans of repositories: a customer is a repository, its orders are its scans in order, line items the findings."""
    title = "f.title"
    return f"""(SELECT concat(CAST(o.o_custkey AS VARCHAR(20)), '/', {title}, ':', f.category) AS key, o.o_custkey AS repo, {title} AS title, f.category, CASE l.l_partkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS severity,
      CASE WHEN l.l_suppkey % 7 = 0 THEN NULL ELSE CAST(l.l_partkey % 101 AS DOUBLE) / 100 END AS confidence, CAST(o.scan AS BIGINT) AS scan,
      CAST(ROW_NUMBER() OVER (PARTITION BY o.o_custkey, o.scan ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice, l.l_shipdate) AS BIGINT) AS pos
      FROM (SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS scan FROM {d.table('orders')} x) o JOIN {d.table('lineitem')} l ON l.l_orderkey = o.o_orderkey
      JOIN {finding_table(d)} f ON (l.l_partkey + l.l_suppkey) % 5 = f.k)"""


def repo_memory(d: Dialect) -> str:
    """What was known before each repository's last scan."""
    s = scans(d)
    last = f"(SELECT repo, MAX(scan) AS newest FROM {s} a GROUP BY repo)"
    return f"""(SELECT s.repo, s.key, CAST(COUNT(*) AS BIGINT) AS seen_count, CAST(MAX(l.newest) - 1 - MAX(s.scan) AS BIGINT) AS absent_scans, MIN(s.pos) % 2 = 0 AS confirmed_fp, MIN(s.pos) % 4 = 0 AS suppressed
      FROM {s} s JOIN {last} l ON s.repo = l.repo WHERE s.scan < l.newest GROUP BY s.repo, s.key)"""


def last_scan(d: Dialect) -> str:
    s = scans(d)
    last = f"(SELECT repo, MAX(scan) AS newest FROM {s} a GROUP BY repo)"
    return f"(SELECT s.repo, s.key, MAX(s.severity) AS severity, CAST(COUNT(*) AS BIGINT) AS n FROM {s} s JOIN {last} l ON s.repo = l.repo AND s.scan = l.newest GROUP BY s.repo, s.key)"


def baseline(d: Dialect) -> str:
    """An earlier scan: the findings of another set of rows, some of them with other severities."""
    i = issues(d)
    return f"(SELECT doc_id, seq, type, CASE WHEN seq % 3 = 0 THEN 'low' ELSE severity END AS severity, title, category FROM {i} b WHERE (doc_id + seq) % 3 <> 1)"


def model_calls(d: Dialect) -> str:
    """A message of a conversation is a call: its role the stage, its conversation the model."""
    models = ["openai/gpt-4o-mini", "openai/gpt-4o", "anthropic/claude-3-haiku", "unknown/model"]
    pick = "CASE CAST(conv_id AS BIGINT) % 4 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(models)) + " END"
    return f"(SELECT role AS stage, {pick} AS model, length(text) AS prompt_chars, length(text) % 97 AS reply_chars FROM {d.table('conversations')})"


def stage_timings(d: Dialect) -> str:
    """An order is a run, its line items are the stages."""
    return f"(SELECT l_orderkey AS run_id, concat('stage-', CAST(l_linenumber AS VARCHAR(10))) AS stage, CAST(l_partkey AS BIGINT) AS start_ms, CAST(l_partkey + l_suppkey AS BIGINT) AS end_ms, l_suppkey % 3 = 0 AS cached FROM {d.table('lineitem')})"


def events(d: Dialect) -> str:
    """Events as gets of a cache: their type the stage, the user the key."""
    return f"(SELECT event_id AS id, event_type AS stage, CAST(user_id AS VARCHAR(20)) AS key, {d.seconds('ts')} AS sec FROM {d.table('events')})"


SUPPRESSIONS = [("s1", 1, "sql", 2_000_000_000), ("s2", 2, "XSS", None), ("s3", 3, "timing", 1), ("s4", 4, "injection", 1_900_000_000), ("s5", 5, "Leak", 1_700_000_000)]


def suppressions(d: Dialect) -> str:
    return d.values(["id", "pos", "pattern", "expires_at"], SUPPRESSIONS)


APPROVALS = [
    (0, 1, "title", "sql*login", "checked by hand", 2_000_000_000), (0, 2, "trust", "trusted|sandbox", "code of our own", None), (1, 3, "title", "xss", "over", 1_700_000_000), (1, 4, "title", "leak", "known", None),
    (2, 5, "trust", "user (input|code)", "inner tool", 1), (2, 6, "title", "rce|eval", "test only", None), (2, 7, "trust", "user (input", "a bracket is missing", None), (3, 8, "title", "[a-", "no end", None),
]


def approvals(d: Dialect) -> str:
    return d.values(["repo", "pos", "kind", "pattern", "reason", "expires_at"], APPROVALS)


def repo_issues(d: Dialect) -> str:
    """Findings of documents of four repositories, each document with a path."""
    return f"(SELECT *, doc_id % 4 AS repo, CASE doc_id % 3 WHEN 0 THEN 'src/api.js' WHEN 1 THEN 'tests/api.test.js' ELSE 'lib/x.py' END AS path FROM {issues(d)} ri)"


#: rules of one's own: as those of the packs, with a part of the title and a pattern of the path
OWN_RULES = [
    ("custom", "own-tests", None, None, None, None, "suppress", "tests are not shipped", None, None, r"^tests/|\.test\."),
    ("custom", "own-sql", "security", None, None, None, "require-fix", "no SQL in the API", None, "SQL", r"^src/"),
    ("custom", "own-dev", None, None, None, None, "annotate", "development only", "development", None, None),
]


def baseline_lines(d: Dialect) -> str:
    """Findings that a later stage left, with their lines."""
    return f"(SELECT * FROM {issues(d)} b WHERE (doc_id + seq) % 3 <> 1)"


def document_lines(d: Dialect) -> str:
    """The documents themselves as files."""
    return f"(SELECT doc_id, COALESCE(text, '') AS code FROM {d.table('documents')})"


def known_nodes(d: Dialect) -> str:
    """Graph nodes of an earlier build: those of two documents in three, one line in five changed since."""
    from ..operators import lines, system

    return f"(SELECT doc_id, line_no, kind, CASE WHEN line_no % 5 = 0 THEN 'changed' ELSE hash END AS hash FROM ({system.graph_nodes(d, f'({lines.parse(d, files(d))})')}) k WHERE doc_id % 3 < 2)"


def answers(d: Dialect) -> str:
    """What a model may say about a line item: JSON with aliases, missing fields and some that is no JSON."""
    kinds = "CASE l_partkey % 5 WHEN 0 THEN 'Vulnerability' WHEN 1 THEN 'warning' WHEN 2 THEN 'note' WHEN 3 THEN 'odd' ELSE 'bug' END"
    levels = "CASE l_suppkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'minor' WHEN 2 THEN 'x' ELSE 'high' END"
    key = "CASE l_partkey % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'name' ELSE 'headline' END"
    body = f"""concat('{{"type": "', {kinds}, '", "severity": "', {levels}, '", "', {key}, '": "Finding ', CAST(l_suppkey AS VARCHAR(10)), '", "line": ', CASE l_linenumber WHEN 1 THEN 'null' ELSE CAST(l_linenumber AS VARCHAR(10)) END, ', "fix": "  use it ", "category": "Logic"}}')"""
    order = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
    place = f"CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY {order}) AS INT)"
    rows = d.table("lineitem")
    if d is SPARK:  # as with issues()
        rows, place = f"(SELECT *, {place} AS place FROM {rows} n)", "place"
    return f"(SELECT l_orderkey AS doc_id, {place} AS seq, CASE WHEN l_partkey % 13 = 0 THEN 'no json' ELSE {body} END AS body FROM {rows})"


def requests(d: Dialect) -> str:
    """Customers as clients: addresses of several kinds, origins that fit or not."""
    n = "CAST(c_custkey % 300 AS VARCHAR(10))"
    return f"""(SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN concat('10.0.', {n}, '.1, 10.0.0.2') WHEN 1 THEN concat(' fe80::', {n}) WHEN 2 THEN 'not an address' ELSE NULL END AS forwarded,
      CASE c_nationkey % 3 WHEN 0 THEN 'https://shop.example' WHEN 1 THEN 'https://evil.example/x' ELSE NULL END AS origin, 'shop.example' AS host FROM {d.table('customer')})"""


def tasks(d: Dialect) -> str:
    """Parts as tasks for models, with what is available."""
    kinds = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(("routing", "syntax", "security", "remediation", "arbitration")))
    return f"(SELECT p_partkey AS id, CASE p_partkey % 5 {kinds} END AS task, CASE p_size % 3 WHEN 0 THEN ',' WHEN 1 THEN ',openai/gpt-4o,anthropic/claude-3-haiku,' ELSE ',local/model,' END AS available FROM {d.table('part')})"


#: Files of a repository in turn: path, language, code. $H is the file's place in its repository, $N the next place, $B that of the service five places back.
REPO_FILES = [
    ("src/routes/r$H.js", "javascript", "import { load$N } from '../services/s$N';\nexport function get$H(req, res) {\n  const id = req.query.id;\n  const row = load$N(id);\n  res.send(row);\n}\n"),
    ("src/services/s$H.js", "javascript", "const { find$N } = require('../db/store$N');\nexport function load$H(key) {\n  const text = key + '!';\n  const out = find$N(text);\n  return out;\n}\n"),
    ("src/db/store$H.js", "javascript", "import { log } from '../../lib/log.js';\nexport function find$H(value) {\n  const rows = db.query(`SELECT * FROM t WHERE id = ${value}`);\n  return rows;\n}\n"),
    ("web/view$H.py", "python", "from web.util$N import clean$N\nfrom flask import request\n\ndef show$H():\n    name = request.args.get('name')\n    path = clean$N(name)\n    return path\n"),
    ("web/util$H/__init__.py", "python", "from ..files$N import read$N\n\ndef clean$H(text):\n    part = text.strip()\n    body = read$N(part)\n    return body\n"),
    ("web/files$H.py", "python", "import os\n\ndef read$H(target):\n    os.system('cat ' + target)\n    data = open(target)\n    return data\n"),
    ("src/routes/safe$H.ts", "typescript", "import { load$B } from '@/services/s$B';\nexport function safe$H(req) {\n  const id = parseInt(req.query.id, 10);\n  const row = load$B(id);\n  return row;\n}\n"),
]


def repo_files(d: Dialect, later: bool = False) -> str:
    """(repo, doc_id, path, code): a customer is a repository, its orders are the files. later: some days on, when one file in 40 was changed: services check their argument, views are gone, others have a line more."""
    table = d.values(["k", "path", "lang", "code"], [(i, *row) for i, row in enumerate(REPO_FILES)])
    placed = f"(SELECT o_orderkey, o_custkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM {d.table('orders')} x)"
    fill = lambda c: f"replace(replace(replace({c}, '$H', CAST(o.place AS VARCHAR(12))), '$N', CAST(o.place + 1 AS VARCHAR(12))), '$B', CAST(o.place - 5 AS VARCHAR(12)))"
    rows = f"SELECT o.o_custkey AS repo, o.o_orderkey AS doc_id, o.place, {fill('c.path')} AS path, {fill('c.code')} AS code FROM {placed} o JOIN {table} c ON o.place % {len(REPO_FILES)} = c.k"
    if not later:
        return f"(SELECT repo, doc_id, path, code FROM ({rows}) rf)"
    kind, hit = f"place % {len(REPO_FILES)}", "doc_id % 40 = 1"
    old, new = d.text("const text = key + '!';"), d.text("const text = parseInt(key, 10);")
    code = f"CASE WHEN {hit} AND {kind} = 1 THEN replace(code, {old}, {new}) WHEN {hit} AND {kind} <> 4 THEN concat({d.text(chr(10))}, code) ELSE code END"
    return f"(SELECT repo, doc_id, path, {code} AS code FROM ({rows}) rl WHERE NOT ({hit} AND {kind} = 3))"


def large_parts(d: Dialect) -> str:
    """(doc_id, place, part): files in parts. The customers of an order decide which: a fourth of all orders make one file, the others 64; every fifth part of a file names the file that it was."""
    doc = "CASE WHEN o.o_custkey % 4 = 0 THEN -1 ELSE o.o_custkey % 64 END"
    part = f"concat(CASE WHEN o.o_orderkey % 5 = 0 THEN concat('// file: part', CAST(o.o_orderkey AS VARCHAR(20)), '.js', {d.text(chr(10))}) ELSE '' END, c.code)"
    return f"(SELECT {doc} AS doc_id, o.o_orderkey AS place, {part} AS part FROM {d.table('orders')} o JOIN {code_table(d)} c ON o.o_orderkey % {len(CODE)} = c.k)"


def large_files(d: Dialect) -> str:
    """(doc_id, code): large_parts() joined to files."""
    return f"(SELECT doc_id, {d.collect('part', 'place', chr(10))} AS code FROM {large_parts(d)} p GROUP BY doc_id)"


#: calls of a route file in turn
ROUTE_CALLS = ["requireAuth, validateBody", "validateBody, requireAuth", "log, validate(x), verifyToken", "limit,\n  checkSchema(s),\n  isAuthenticated", "handlerOnly"]


def route_files(d: Dialect) -> str:
    """(doc_id, code): a file of routes for each customer, a route per call of ROUTE_CALLS in an order of its own."""
    calls = d.values(["k", "args"], list(enumerate(ROUTE_CALLS)))
    part = f"concat('app.post(', {d.text(chr(39))}, '/r', CAST(k AS VARCHAR(9)), {d.text(chr(39))}, ', ', args, ', handle);')"
    return f"(SELECT doc_id, {d.collect('part', 'place', chr(10))} AS code FROM (SELECT c_custkey AS doc_id, (k * 2 + c_custkey) % {len(ROUTE_CALLS)} AS place, {part} AS part FROM {d.table('customer')} c CROSS JOIN {calls} rc) p GROUP BY doc_id)"
