"""Line operators in segments against those that order a whole file at once, and a file of a million lines."""

import random

import pytest
from pyspark.sql import functions as F

from gridwarden.functions.run import apply
from gridwarden.functions.tables import written
from gridwarden.operators import lines as L
from gridwarden.operators import segments as S

PARTS = [
    "function f{i}(a) {{", "def g{i}(x):", "class C{i}:", "  if (false) {{", "    return a;", "  throw new Error('x');", "// file: part{i}.js", "", "    ", "if (LIMIT === 1) {{", "const LIMIT = 2;", "      deep(a);", "  x = 1;", "}}", "requireAuth, adminOnly",
    "isAdmin(user)", "internal_only = true", "if (process.env.NODE_ENV === 'test') {{", "\tindented", "raise ValueError()", "* starred", "'quoted'",
]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(5)
    text = lambda n: "\n".join(" " * rng.randrange(0, 7) * rng.randrange(2) + rng.choice(PARTS).format(i=rng.randrange(9)) for _ in range(n))
    rows = [(k, text(n)) for k, n in enumerate([0, 1, 2, 31, 32, 33, 63, 64, 65, 500, 1999])] + [(99, "same\n" * 40), (98, "\n".join(" " * (200 - i) + "return 1" for i in range(200))), (97, "\n".join(" " * i + "return 1" for i in range(200)))]
    return written(spark.createDataFrame(rows, "doc_id long, code string"), "files")


def same(a, b):
    assert sorted(map(tuple, a.select(*b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("size", [32, 100])
def test_segments_equal_whole_files(spark, files, size):
    whole = written(apply(L.parse, files=files), "lines")
    cut = S.parse(files, size)
    same(cut, whole)
    same(S.enclosing(cut), apply(L.enclosing, lines=whole))
    same(S.dead(cut, size), apply(L.dead, lines=whole))
    same(S.reachability(cut, size), apply(L.reachability, lines=whole))
    starts = whole.where("trimmed <> '' AND line_no % 3 = 0").select("doc_id", "line_no", "indent")
    same(S.block_ends(starts, cut, size), apply(lambda d, starts, rows: f"SELECT doc_id, line_no, until FROM {L._ends(d, starts, rows)} e", starts=starts, rows=whole.select("doc_id", "line_no", "indent")))


def test_empty_and_rims(spark, files):
    none = S.parse(files.limit(0))
    assert none.count() == 0 and S.dead(none).count() == 0 and S.enclosing(none).count() == 0 and S.reachability(none).count() == 0
    with pytest.raises(ValueError):
        S.near(none, "raw", 15, 15, "around", 10)


def test_a_million_lines_among_small_files(spark):
    """One file of 10^6 lines uses all tasks: no task gets more than its share of segments."""
    n = 1_000_000
    body = "\n".join(f"x{i} = {i}" if i % 1000 else f"function f{i}(a) {{" for i in range(n))
    files = written(spark.createDataFrame([(1, body), *((k, "function small(a) {\n  return a;\n}") for k in range(2, 50))], "doc_id long, code string"), "files")
    cut = S.parse(files)
    told = S.enclosing(cut).where("doc_id = 1")
    assert told.count() == n
    wrong = told.where(F.col("fn") != F.concat(F.lit("f"), (F.floor((F.col("line_no") - 1) / 1000) * 1000).cast("string")))
    assert wrong.count() == 0
    dealt = cut.repartition(4, *S.KEY).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 4 and max(r["count"] for r in dealt) < 0.4 * n
    plan = S.enclosing(cut)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan


TOKENS = ["if", "IF (", "(", "false", "false)", ")", "0)", "if (0", "if(false)", "//", "// TODO", "TODO remove", "/*", "DEAD", "dead */", "*/", "process.env.NODE_ENV", "===", "'development'", "!== `production`", "isDev", "debug ==", "true", "? 1", "&&", "/admin/", "localhost", "", "  ", "\r", "\t"]


@pytest.mark.parametrize("size", [7, 32])
def test_reach_patterns_over_line_ends(spark, size):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice(TOKENS) for _ in range(rng.randrange(1, 3))) if rng.random() < 0.12 else rng.choice(["x = 1;", "", "isAdmin(user)", "  ", "y"])
    rows = [(k, "\n".join(line() for _ in range(rng.randrange(1, 160)))) for k in range(120)]
    rows += [(200 + k, "x\n" * rng.randrange(20) + a + "\n" * rng.randrange(1, 9) + b + "\nx" * rng.randrange(20)) for k, (a, b) in enumerate((a, b) for a in TOKENS for b in TOKENS)]
    files = written(spark.createDataFrame(rows, "doc_id long, code string"), "files")
    whole = written(apply(L.parse, files=files), "lines")
    same(S.reachability(S.parse(files, size), size), apply(L.reachability, lines=whole))


def test_reachability_deals_lines_out_once(spark, files):
    plan = S.reachability(S.parse(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
