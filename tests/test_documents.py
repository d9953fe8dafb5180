"""Programs within a document, state tables and streams."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridwarden.operators import documents as D
from gridwarden.sources import state
from gridwarden.streaming import stateful


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": "}{"}\n``` bye', {"a": "}{"}),
        ('so: {"a": {"b": "x\\"}"}} and {"c": 1}', {"a": {"b": 'x"}'}}),
        ('{"issues": [1, 2,], }', {"issues": [1, 2]}),
        ('{"issues": [], "optimized_code": "abc', {"issues": []}),
        ('{"issues": [{"t": 1}, {"t": 2}, {"t"', {"issues": [{"t": 1}, {"t": 2}], "summary": "incomplete", "score": 0}),
        ("All is well with this code.", None),
        ("", None),
        ("[1]", None),
    ],
)
def test_answers_are_read(text, want):
    got = D.read_answer(text)
    assert (json.loads(got) if got else None) == want


def test_prose_is_told(spark):
    df = spark.createDataFrame([(1, "Everything looks safe to me"), (2, "{bad"), (3, None), (4, '{"a":1}')], "id int, text string")
    assert {r.id: r.is_prose for r in D.read_answers(df).collect()} == {1: True, 2: False, 3: None, 4: False}


def test_banded_like_a_plain_scan():
    random.seed(1)
    for _ in range(300):
        rows = [(random.choice("ab"), random.randint(-1, 20), i) for i in range(random.randint(0, 25))]
        kept, gone = [], set()
        for t, n, s in rows:
            if any(a == t and abs(b - n) <= 3 for a, b in kept):
                gone.add(s)
            else:
                kept.append((t, n))
        assert D.banded(rows) == gone


def test_titles_are_cut_before_where_and_how():
    assert D.short_title("SQL  Injection via the username in login") == "sql injection"


def test_blocks_close_by_braces():
    code = "function a() {\n  const b = (x) => {\n    eval(x)\n  }\n}\nconst c = (y) => { return y }"
    assert D.function_blocks(code) == [("b", 2, 4, 10), ("a", 1, 5, 10)]


def test_context_keeps_what_matters():
    code = "import x\n" + "a\n" * 100 + "eval(z)\n" + "b\n" * 100
    got = D.context(code, 300)
    assert "1: import x" in got and "102: eval(z)" in got and "lines left out" in got and len(got) <= 300
    assert D.context("short", 300) == "short"


def test_patches():
    assert D.patch_line("sqli-template", "  db.query(`SELECT * FROM t WHERE id = ${id}`);") == "  db.query('SELECT * FROM t WHERE id = ?', [id]);"
    assert D.patch_line("cmd-injection-exec", "  exec(`ping ${host}`)") == "  spawn('ping', [host], { shell: false })"
    code = "import a from 'a';\nbox.innerHTML = note;\nx\nif (token === secret) y;"
    new, n = D.patch(code, [("xss-innerhtml", 2), ("timing-attack-comparison", 4), ("xss-innerhtml", 2), ("rce-eval", 3), ("xss-innerhtml", 99)])
    assert n == 2 and new.split("\n") == ["import a from 'a';", "import crypto from 'crypto';", "import DOMPurify from 'dompurify';", "box.innerHTML = DOMPurify.sanitize(note);", "x", "if (crypto.timingSafeEqual(Buffer.from(token), Buffer.from(secret))) y;"]


def test_memory_survives_scans(spark, tmp_path):
    path = f"{tmp_path}/memory"
    scan = lambda *rows: spark.createDataFrame(list(rows), "repo string, key string, severity string, n long")
    state.record_scan(spark, path, scan(("r1", "a", "low", 1), ("r2", "z", "low", 1)))
    state.mark_false_positive(spark, path, "r1", "a")
    for _ in range(2):
        state.record_scan(spark, path, scan(("r1", "a", "low", 1)))
    got = {(r.repo, r.key): (r.seen_count, r.suppressed) for r in state.load_memory(spark, path).collect()}
    assert got == {("r1", "a"): (3, True), ("r2", "z"): (1, False)}


def test_suppressions_end(spark):
    none = spark.createDataFrame([], state.SUPPRESSIONS)
    one = state.add_suppression(none, "sql", "known", "me", 1000, 1)
    assert state.purge_suppressions(one, 1000).count() == 1 and state.purge_suppressions(one, 1000 + 86_400).count() == 0


def test_requests_are_sorted(spark):
    rows = [('{"code": " x ", "model": "auto"}',), ('{"code": "x", "language": "cobol"}',), ("nope",), ('{"model": "auto"}',), ('{"code": "x", "model": "big"}',)]
    good, bad = state.read_requests(spark.createDataFrame(rows, "body string"))
    assert [r.code for r in good.collect()] == ["x"]
    assert sorted(r.refused for r in bad.collect()) == ["invalid JSON", "no code", "unknown language", "unknown model"]


def test_sources_and_reports(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.js").write_text("one\ntwo")
    assert [r.code for r in state.read_sources(spark, f"{tmp_path}/in").collect()] == ["one\ntwo"]
    df = spark.createDataFrame([(1, 2, "high", "b"), (1, 1, "low", "a")], "doc_id long, seq int, severity string, title string")
    state.write_report(df, f"{tmp_path}/out")
    got = json.loads(spark.read.text(f"{tmp_path}/out").first()[0])
    assert got["counts"] == {"high": 1, "medium": 0, "low": 1} and [i["title"] for i in got["issues"]] == ["a", "b"]


def test_rate_limit_window_starts_with_the_first_request(spark, tmp_path):
    start = datetime(2026, 1, 1, 0, 0, 50)
    rows = [("a", start + timedelta(seconds=s)) for s in (0, 1, 2, 59, 60, 61, 62)] + [(None, start + timedelta(seconds=s)) for s in range(4)]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/in")
    got = {r.key: (r.n, r.allowed, r.refused) for r in stateful.to_table(stateful.limit_requests(stream, limit=2, unknown_limit=3), f"{tmp_path}/out").collect()}
    # two in the window of 60 s from the first, its end included; then a new one from second 61
    assert got == {"a": (7, 4, 3), "unknown": (4, 3, 1)}


def test_drift_label():
    assert stateful.drift([0.1]) == (0.0, "stable")
    assert stateful.drift([0.1, 0.25, 0.4])[1] == "escalating" and stateful.drift([0.4, 0.25, 0.1])[1] == "resolving" and stateful.drift([0.0, 0.9, 0.0, 0.9])[1] == "volatile"


def test_tracking_goes_on_over_batches(spark, tmp_path):
    at = datetime(2026, 1, 1)
    for i, values in enumerate(([0.1, 0.2], [0.3, 0.4])):
        spark.createDataFrame([("k", at + timedelta(hours=2 * i + j), v) for j, v in enumerate(values)], "key string, ts timestamp, confidence double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("key string, ts timestamp, confidence double").parquet(f"{tmp_path}/in")
        rows = stateful.to_table(stateful.track_findings(stream), f"{tmp_path}/out", "update")
    assert rows.agg(F.max("seen")).first()[0] == 4
    assert rows.where("seen = 4").first().label in ("stable", "escalating")
