"""Findings whose patterns look at some of their columns: each combination of these is looked at once, and findings are sent along once, without their texts."""

import os
import random
import re

import duckdb
import pytest

from gridwarden.functions import texts
from gridwarden.functions.dialect import DUCK
from gridwarden.operators import documents
from gridwarden.plans import registry
from gridwarden.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables in which some line items have no finding: they are not numbered."""
    top = str(tmp_path_factory.mktemp("odd"))
    for f in os.listdir(SF):
        os.symlink(f"{SF}/{f}", f"{top}/{f}")
    os.unlink(f"{top}/lineitem.parquet")
    with duckdb.connect() as con:
        con.execute(f"COPY (SELECT * REPLACE (CASE WHEN l_partkey % 10 = 3 THEN NULL WHEN l_partkey % 10 = 4 THEN -l_partkey * 100 ELSE l_partkey END AS l_partkey) FROM '{SF}/lineitem.parquet') TO '{top}/lineitem.parquet'")
    return top


def _looked(spark, monkeypatch, name):
    looked = []
    once = texts.once
    monkeypatch.setattr(texts, "once", lambda rows, columns, tell: once(rows, columns, lambda own: looked.append((own.count(), rows.count())) or tell(own)))
    df = registry.QUERIES[name](spark, SF)
    return df, looked


def _sent(df) -> int:
    """Exchanges of the plan in which rows are dealt out by keys, but for those of the driver's tables as they are read."""
    return len(re.findall(r"Exchange hashpartitioning\(.*ENSURE_REQUIREMENTS", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize(("name", "times"), [("root_cause", 1), ("family_clusters", 1), ("two_step_chains", 1), ("stage_results", 2)])
def test_each_combination_is_looked_at_once(spark, monkeypatch, name, times):
    _, looked = _looked(spark, monkeypatch, name)
    assert len(looked) == times
    assert all(few < many for few, many in looked)


@pytest.mark.parametrize("name", ["root_cause", "family_clusters", "stage_results"])
def test_findings_are_dealt_out_by_document_and_stay_so(spark, name):
    # line items are read in one part, dealt out as they are read: no more exchanges are needed
    assert _sent(registry.QUERIES[name](spark, SF)) <= 1


def test_line_items_without_a_finding_are_not_numbered(spark, odd):
    got = sorted(map(tuple, registry._issues(spark, odd).select("doc_id", "seq", "title", "line", "confidence").collect()), key=repr)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{odd}/lineitem.parquet'")
        want = sorted(con.execute(f"SELECT doc_id, seq, title, line, confidence FROM {fixtures.issues(DUCK)} i").fetchall(), key=repr)
    assert got == want and got


def test_stages_in_one_pass_are_the_stages_joined(spark, odd):
    with duckdb.connect() as con:
        for f in ("lineitem", "orders"):
            con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{odd}/{f}.parquet'")
        want = con.execute(registry.ORACLES["stage_results"])
        names = [c[0] for c in want.description]
        assert sorted(map(tuple, registry.QUERIES["stage_results"](spark, odd).select(*names).collect())) == sorted(want.fetchall())


def _plain_object(text):
    depth, start, quoted, skip = 0, -1, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif c == "\\" and quoted:
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            start = i if depth == 0 else start
            depth += 1
        elif not quoted and c == "}":
            depth -= 1
            if depth == 0 and start >= 0:
                return text[start : i + 1]
    return None


def test_first_object_is_that_of_a_walk_over_all_characters():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice('{}{}""\\a\n') for _ in range(rng.randrange(14)))
        assert documents.outermost_object(text) == _plain_object(text), repr(text)


def test_first_object_is_parsed_as_if_it_were_cut_out_before():
    rng = random.Random(6)
    parts = ['{"a": 1}', '{"a": {"b": "}"}}', "{", "}", '"', "\\", "x", '{"a": [1, 2,]}', "{}", " "]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(6)))
        assert (documents._first_parsed(text) or None) == (documents._parsed(_plain_object(text)) or None), repr(text)


def test_answers_are_not_walked_over_where_they_are_read_in_one_go(monkeypatch):
    asked = []
    real = documents.outermost_object
    monkeypatch.setattr(documents, "outermost_object", lambda text: asked.append(text) or real(text))
    assert documents.read_answer('{"a": 1}') == '{"a": 1}' and not asked
    assert documents.read_answer('so: ```json{"b": {"c": "}"}, "a": 1}``` end') == '{"a": 1, "b": {"c": "}"}}' and not asked
    assert documents.read_answer('a "{" and {"a": 1}') == '{"a": 1}' and len(asked) == 1
