"""Files of a repository together: fixpoints, flows between files, the graph kept between scans, and its store."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridwarden.functions.run import apply
from gridwarden.functions.tables import written
from gridwarden.operators import fixpoint, incremental, repository
from gridwarden.plans import QUERIES
from gridwarden.sources.snapshots import Conflict, Store

SEEDS, EDGES = "scope long, node string, origin string", "scope long, src string, dst string"


def brute(seeds, edges):
    """(scope, node) to (hops, origin), by rounds over dictionaries."""
    out = {}
    for s, n, o in seeds:
        out[s, n] = min(out.get((s, n), (0, o)), (0, o))
    after = defaultdict(set)
    for s, a, b in edges:
        after[s, a].add(b)
    round_ = dict(out)
    while round_:
        found = {}
        for (s, a), (h, o) in round_.items():
            for b in after[s, a]:
                if (s, b) not in out:
                    found[s, b] = min(found.get((s, b), (h + 1, o)), (h + 1, o))
        out |= found
        round_ = found
    return out


def told(df):
    rows = df.collect()
    out = {(r.scope, r.node): (r.hops, r.origin) for r in rows}
    assert len(out) == len(rows)
    return out


def graph(rng, scopes, nodes, edges, seeds):
    name = lambda: f"n{rng.randrange(nodes)}"
    e = {(rng.randrange(scopes), name(), name()) for _ in range(edges)}
    s = {(rng.randrange(scopes), n := name(), n) for _ in range(seeds)}
    return s, e


def frames(spark, seeds, edges):
    return spark.createDataFrame(sorted(seeds), SEEDS), spark.createDataFrame(sorted(edges), EDGES)


def test_settle_and_maintain_random_graphs(spark):
    rng = random.Random(3)
    s, e = graph(rng, 3, 60, 160, 6)
    old = [*frames(spark, s, e)]
    reached = fixpoint.settle(*old)
    assert told(reached) == brute(s, e)
    for share in (0.02, 0.3):
        s2 = {x for x in s if rng.random() > share} | graph(rng, 3, 60, 0, 2)[0]
        e2 = {x for x in e if rng.random() > share} | graph(rng, 3, 60, round(160 * share), 0)[1]
        new = [*frames(spark, s2, e2)]
        change = fixpoint.maintain(reached, *old, *new)
        want = brute(s2, e2)
        assert told(change.reached) == want
        before = told(reached)
        differ = {k for k in before.keys() | want.keys() if before.get(k) != want.get(k)}
        assert differ <= {(r.scope, r.node) for r in change.touched.collect()}
        s, e, old, reached = s2, e2, new, change.reached


def test_maintain_edge_cases(spark):
    chain = {(0, f"{i}", f"{i + 1}") for i in range(6)} | {(0, "3", "1")}
    seeds = {(0, "0", "0")}
    old = frames(spark, seeds, chain)
    reached = fixpoint.settle(*old)
    cases = [
        (seeds, chain - {(0, "0", "1")}),  # the cycle behind must not keep itself alive
        (set(), chain),
        (seeds, chain | {(0, "0", "5")}),
        (seeds | {(0, "4", "4")}, chain - {(0, "3", "4")}),
        (seeds, set()),
        (seeds, chain),
    ]
    for s, e in cases:
        change = fixpoint.maintain(reached, *old, *frames(spark, s, e))
        assert told(change.reached) == brute(s, e)
    assert change.touched.count() == 0
    empty = frames(spark, set(), set())
    assert fixpoint.settle(*empty).count() == 0


def test_one_large_repository(spark):
    """10^6 edges in one scope, spread over all tasks; a change far out touches only what lies behind it."""
    n = 1_000_000
    ids = spark.range(1, n + 1)
    # a tree of 16 branches a node, six levels
    edges = written(ids.select(F.lit(0).cast("long").alias("scope"), F.floor((F.col("id") - 1) / 16).cast("string").alias("src"), F.col("id").cast("string").alias("dst")), "edges")
    seeds = spark.createDataFrame([(0, "0", "0")], SEEDS)
    reached = fixpoint.settle(seeds, edges)
    level = F.lit(0)
    for k in range(1, 6):
        level += (F.col("node").cast("long") > sum(16**j for j in range(1, k))).cast("int")
    assert reached.count() == n + 1
    assert reached.where("node <> '0'").where(F.col("hops") != level).count() == 0
    per_task = edges.repartition(4, "scope", "src").groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) == 4  # nodes are what work is dealt out by, not the scope
    moved = written(edges.where("dst <> '70000'").unionByName(spark.createDataFrame([(0, "0", "70000")], EDGES)), "edges")
    change = fixpoint.maintain(reached, seeds, edges, seeds, moved)
    below = 1 + 16 * (70000 * 16 + 1 <= n)
    assert change.touched.count() <= 1 + 16 + 256 and change.touched.count() >= min(below, 1)
    got = {r.node: r.hops for r in change.reached.where("node IN ('0', '70000', '5')").collect()}
    assert got == {"0": 0, "70000": 1, "5": 1} and change.reached.count() == n + 1


FILES = [
    (1, 10, "src/routes/a.js", "import { load } from '../svc/b';\nexport function get(req, res) {\n  const id = req.query.id;\n  const row = load(id, 3);\n  res.send(row);\n}"),
    (1, 11, "src/svc/b.js", "const { find } = require('../db');\nexport function load(key, n) {\n  const text = key + '!';\n  const out = find(n, text);\n  return out;\n}"),
    (1, 12, "src/db/index.js", "export function find(limit, value) {\n  const words = `SELECT * FROM t WHERE id = ${value}`;\n  db.query(words);\n  return words;\n}"),
    (1, 13, "src/other.js", "export function find(value) {\n  return db.query(`SELECT 1 + ${value}`);\n}"),
    (2, 20, "a.js", "import { load } from './svc/b';\nexport function get(req) {\n  const id = req.query.id;\n  load(id);\n}"),
    (2, 21, "svc/c.js", "export function load(key) {\n  db.query(`SELECT ${key}`);\n}"),
    (3, 30, "web/view.py", "from web.util import clean\nfrom .files import read\n\ndef show():\n    name = request.args.get('name')\n    path = clean(name)\n    read(path)\n"),
    (3, 31, "web/util/__init__.py", "def clean(self, text=''):\n    part = text.strip()\n    return part\n"),
    (3, 32, "web/files.py", "def read(self, goal):\n    os.system('cat ' + goal)\n"),
]


def files_of(spark, rows=FILES):
    return written(spark.createDataFrame(rows, "repo long, doc_id long, path string, code string"), "files")


def found(g):
    return {(r.doc_id, r.line_no, r.sink, r.var): (r.hops, r.source_doc, r.source_var, r.across) for r in g.findings.collect()}


def test_flows_through_two_imports(spark):
    g = incremental.build(files_of(spark))
    names = told(g.reached)
    assert names[1, "10:id"] == (0, "10:id") and names[1, "11:key"] == (1, "10:id") and names[1, "11:text"] == (2, "10:id") and names[1, "12:value"] == (3, "10:id")
    assert (1, "12:limit") not in names  # n is no tainted argument
    assert (1, "13:value") not in names  # a find() that nobody imports
    assert names[1, "12:words"][0] == 4 and names[1, "11:out"][0] == 5 and names[1, "10:row"][0] == 6  # and back through what is returned
    assert (2, "21:key") not in names  # ./svc/b is not there
    got = found(g)
    assert got[12, 3, "sql", "words"] == (4, 10, "id", True)
    assert got[10, 5, "xss", "row"] == (6, 10, "id", False)
    assert not [k for k in got if k[0] in (13, 21)]


@pytest.mark.parametrize(
    ("path", "word", "target"),
    [
        ("src/a/x.js", "./y", "src/a/y"), ("src/a/x.js", "../y.js", "src/y"), ("src/a/x.js", "../../y", "y"), ("src/a/x.js", "../../../y", None), ("src/a/x.js", "@/y", "src/y"), ("x.js", "./y", "y"), ("x.js", "../y", None),
        ("src/a/x.js", "left-pad", None), ("src/a/x.js", "./folder", "src/a/folder/index"), ("p/q/x.py", ".y", "p/q/y"), ("p/q/x.py", "..y", "p/y"), ("p/q/x.py", "p.y", "p/y"), ("p/q/x.py", ".", "p/q/name"), ("p/q/x.py", "....y", None),
    ],
)
def test_import_paths(spark, path, word, target):
    ext = ".py" if path.endswith(".py") else ".js"
    files = files_of(spark, [(1, 1, path, ""), *([(1, 2, target + ext, "")] if target else []), (2, 3, "src/a/y.js", ""), (1, 4, "z/other.js", "")])
    facts = spark.createDataFrame([(1, 1, "import", 1, "name", 0, word)], "repo long, doc_id long, fact string, line_no int, name string, place int, word string")
    got = [(r.doc_id, r.name, r.target) for r in apply(repository.links, facts=facts, files=files).collect()]
    assert got == ([(1, "name", 2)] if target else [])


def changed_files(rows):
    by = {r[1]: r for r in rows}
    by[11] = (1, 11, "src/svc/b.js", by[11][3].replace("key + '!'", "parseInt(key, 10)"))  # a check
    by[22] = (2, 22, "svc/b.js", by[21][3])  # the missing file
    by[32] = (3, 32, "web/files.py", "\n" + by[32][3])  # a line more
    del by[13]
    return list(by.values())


def same_graph(a, b):
    for t in incremental.TABLES:
        x, y = (getattr(g, t).drop("dirty") for g in (a, b))
        assert sorted(map(tuple, x.collect()), key=repr) == sorted(map(tuple, y.select(*x.columns).collect()), key=repr), t


def test_update_equals_build_and_touches_little(spark):
    g = incremental.mark_clean(incremental.build(files_of(spark)))
    later = changed_files(FILES)
    new, stats = incremental.update(g, files_of(spark, later))
    same_graph(new, incremental.build(files_of(spark, later)))
    assert not [k for k in found(new) if k[0] == 12] and [k for k in found(new) if k[0] == 22]
    assert stats["files_read"] == 3 and stats["files_gone"] == 1 and stats["scopes"] == 3
    marks = {(r.doc_id, r.line_no) for r in incremental.dirty(new).collect()}
    assert marks == {(22, 2)}  # db.query of the new file; nodes of changed files whose line stayed are clean
    again, stats = incremental.update(incremental.mark_clean(new), files_of(spark, later))
    same_graph(again, new)
    assert not any(stats.values()) and incremental.dirty(again).count() == 0
    back = incremental.downstream(g, spark.createDataFrame([(1, "11:key")], "scope long, node string"))
    assert {(r.node, r.hops) for r in back.collect()} >= {("11:text", 1), ("12:value", 2), ("10:row", 5)}


def test_small_change_of_many_repositories(spark):
    """One file in a hundred repositories changes: no other repository is read, joined or judged."""
    rows = [(k, 100 * k + d, p, c) for k in range(100) for r, d, p, c in FILES if r == 1]
    g = incremental.mark_clean(incremental.build(files_of(spark, rows)))
    later = [(k, d, p, c.replace("key + '!'", "parseInt(key, 10)") if k == 7 else c) for k, d, p, c in rows]
    new, stats = incremental.update(g, files_of(spark, later))
    assert stats["files_read"] == 1 and stats["scopes"] == 1 and stats["files_judged"] <= 4 and stats["names_touched"] <= 8
    same_graph(new, incremental.build(files_of(spark, later)))


def test_store_of_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert incremental.load(store) == (None, 0)
    g = incremental.build(files_of(spark))
    assert incremental.save(g, store, 0) == 1
    known, version = incremental.load(store)
    same_graph(known, g)
    new, _ = incremental.update(incremental.mark_clean(known), files_of(spark, changed_files(FILES)))
    # a writer that dies half-way: some of its tables are there, its manifest is not
    new.files.write.parquet(str(tmp_path / "store/data/half/files"))
    (tmp_path / "store/manifests/.draft-half").write_text('{"version": 2')
    assert store.latest() == 1
    same_graph(incremental.load(store)[0], g)
    # two writers that read version 1: one is refused, also if both saw that version as the newest
    other = Store(spark, str(tmp_path / "store"))
    assert incremental.save(new, store, version) == 2
    with pytest.raises(Conflict):
        incremental.save(g, other, version)
    other.latest = lambda: 1
    with pytest.raises(Conflict):
        incremental.save(g, other, version)
    assert store.versions() == [1, 2]
    same_graph(incremental.load(store)[0], new)
    assert incremental.reset(store) == 3 and incremental.load(store) == (None, 3)
    assert store.load(1)["files"].count() == len(FILES)
    gone = store.vacuum(keep=1)
    assert "half" in gone and store.versions() == [3]


def test_unchanged_tables_are_not_written_again(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("y")}, 0, {"by": "me"})
    kept = store.load()
    store.save({"a": kept["a"], "b": spark.range(5).toDF("y")}, 1)
    assert store._manifest(1)["tables"]["a"] == store._manifest(2)["tables"]["a"] and store.note(1) == {"by": "me"}
    assert store.load()["b"].count() == 5 and store.load(1)["b"].count() == 2


def test_queries_of_given_tables(spark):
    flows = QUERIES["repo_flows"](spark, "/root/testdata/sf0.001")
    assert flows.where("across").count() > 100 and flows.where("across AND hops < 3").count() == 0
    later = QUERIES["incremental_flows"](spark, "/root/testdata/sf0.001")
    assert later.exceptAll(flows.select(*later.columns)).count() + flows.select(*later.columns).exceptAll(later).count() > 0
