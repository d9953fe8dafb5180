"""Source trees as a data source, rules in SQL, and a scan that counts itself."""

import os

import pytest
from pyspark.sql import functions as F

from gridwarden.operators import observed
from gridwarden.plans import QUERIES
from gridwarden.sources import trees

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for i in range(10_000):
        folder = top / f"d{i % 100:02d}"
        folder.mkdir(exist_ok=True)
        (folder / f"f{i}.{('js', 'py', 'ts')[i % 3]}").write_text(f"const a{i} = 1;\n" * (1 + i % 5))
    for name, text in {"readme.md": "no source", "node_modules/x.js": "x", ".git/y.py": "y", "big.py": "#" * 5000, "odd.js": "é\n\x00"}.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(text)
    (top / "bad.js").write_bytes(b"\xff\xfe")
    return top


@pytest.fixture
def source(spark, tree):
    trees.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda **o: spark.read.format("source_tree").options(**o).load(str(tree))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_tree_of_many_files(source):
    rows = source(partBytes="50000", fileBytes="4000")
    assert rows.count() == 10_003 and rows.rdd.getNumPartitions() > 5
    odd = {r.path: (r.size, r.lang, r.code) for r in rows.where("path IN ('big.py', 'odd.js', 'bad.js', 'd07/f7.py')").collect()}
    assert odd == {"big.py": (5000, "python", None), "odd.js": (4, "javascript", "é\n\x00"), "bad.js": (2, "javascript", "��"), "d07/f7.py": (42, "python", "const a7 = 1;\n" * 3)}
    # rows of a part are of about so many bytes
    sizes = [r[0] for r in rows.groupBy(F.spark_partition_id()).agg(F.sum("size")).select("sum(size)").collect()]
    assert max(sizes) <= 50_000


def test_filters_choose_files_before_they_are_opened(source, tree):
    some = source().where("path LIKE 'd07/%' AND lang = 'python' AND size > 20")
    names = sorted(r.path for r in some.collect())
    want = sorted(os.path.relpath(p, tree) for p in map(str, (tree / "d07").glob("*.py")) if os.path.getsize(p) > 20)
    assert names == want and len(want) > 10
    reader = trees.TreeReader({"path": str(tree)})
    left = list(reader.pushFilters([trees.StringStartsWith(("path",), "d07/"), trees.EqualTo(("lang",), "python"), trees.EqualTo(("code",), "x")]))
    assert [type(f) for f in left] == [trees.EqualTo] and left[0].attribute == ("code",)
    listed = [p for part in reader.partitions() for p, _ in part.files]
    assert listed and all(p.startswith("d07/") and p.endswith(".py") for p in listed)
    seen, scan = [], os.scandir
    try:
        os.scandir = lambda p: seen.append(str(p)) or scan(p)
        reader.partitions()
    finally:
        os.scandir = scan
    assert len(seen) == 2  # the top and d07
    assert source().where("path = 'nowhere.js'").count() == 0


def test_rules_in_sql(spark, source):
    spark.createDataFrame([(1, "a = eval(x)\nb\nexec(y)"), (2, None), (3, "")], "doc_id long, code string").createOrReplaceTempView("some_files")
    got = spark.sql(r"SELECT * FROM match_rules(TABLE(SELECT * FROM some_files), 'run=eval|exec', 'b=^b$')").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "run", "eval"), (1, 2, "b", "b"), (1, 3, "run", "exec")]


def test_a_scan_counts_itself(spark):
    from gridwarden.plans.registry import _files

    verdicts, stages = observed.scan_files(_files(spark, SF))
    got = {r.stage: (r.rows_in, r.rows_out) for r in stages.collect()}
    want = QUERIES["scan_verdicts"](spark, SF)
    assert sorted(map(tuple, verdicts.collect()), key=repr) == sorted(map(tuple, want.select(*verdicts.columns).collect()), key=repr)
    assert got["parse"][0] == 1500 and got["live lines"][0] == got["parse"][1] > got["live lines"][1] == got["findings"][0]
    assert got["findings"][1] == got["severe"][0] and got["verdicts"][1] == got["gate"][0] == verdicts.count() and got["gate"][1] == verdicts.where("gate_pass").count()
    text = observed.summary(stages).first().summary
    assert text.startswith("parse 1500 > ") and text.count(";") == 7
