"""Line dedup, periodic runs and the manifest: whole tables against plain forms, and odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from gridwarden.llm import line_dedup, merkle_manifest, periodic_runs, queries

from .brute import SPACES, lower, sha
from .test_contracts import ODD, SF, same

LINE = "this very line stands in many documents of the corpus"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*ODD, f"a\n {LINE.upper()}\t\nb\n{LINE}", f"{LINE}\r", f"\n{LINE}\n{LINE}\n", LINE, LINE, "é" * 40, "é" * 40 + "x", "x" * 39]
    rows = [(i, t, "s", 5, "en") for i, t in enumerate(texts)] + [(None, LINE, None, None, None), (None, "é" * 40, None, None, "de"), (3, "one two", "s", 1, "en"), (3, "one two", "s", 1, "en")]
    rows += [(90 + i, "é" * 40, "s", 1, "fr") for i in range(4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, lang string").repartition(3)


def table(spark, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*columns).collect()]


# lines


def key(line):
    return lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def dedup_rows(rows):
    """rows: (id, text); a document is a row."""
    held, low = {}, lambda k: (k is not None, k)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(doc)
    kept = {k: max(ids, key=low) for k, ids in held.items() if len(ids) >= 5}
    for doc, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if kept.get(key(x), doc) == doc]
        yield doc, len(lines), len(lines) - len(left), sha("\n".join(left))


def test_op11(spark, odd):
    same(queries.op11_line_dedup(spark, SF), dedup_rows(table(spark, "doc_id", "text")))
    want = list(dedup_rows([(r.doc_id, r.text) for r in odd.collect()]))
    assert sum(n for _, _, n, _ in want) > 10
    for limit in (1_000_000, 0):  # both ways of bringing shared lines to the texts
        got = line_dedup.drop_shared_lines(odd, keep=["doc_id"], broadcast_lines=limit)
        same(got.select("doc_id", "n_lines", "n_dropped", "kept_sha256"), want)
        assert all(hashlib.sha256(r.left.encode()).hexdigest() == r.kept_sha256 for r in got.collect())


def test_op11_columns_and_empty_table(spark, odd):
    extra = odd.selectExpr("doc_id", "text", "1 AS N_LINES", "'x' AS id", "2 AS c0", "3 AS body", "4 AS gone")
    got = line_dedup.drop_shared_lines(extra)
    assert got.columns == ["doc_id", "text", "id", "c0", "body", "gone", "n_lines", "n_dropped", "kept_sha256", "left"]
    assert got.select("id", "c0", "body", "gone").distinct().collect() == [("x", 2, 3, 4)]
    assert line_dedup.drop_shared_lines(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.drop_shared_lines(odd, least_docs=1)


def test_op11_filters_lose_no_repeat(spark, monkeypatch):
    """What two documents share is always suspected, in one task or several; most other lines are not. Small filters only suspect more."""
    lines = [f"{i:06d} " + "word " * 10 for i in range(20_000)]
    rows = [(i, "\n".join(lines[20 * i : 20 * i + 22])) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    n = line_dedup.segments_for(sum(len(t) for _, t in rows))
    bits = np.zeros((n, line_dedup.SEGMENT_BITS // 8), dtype=np.uint8)
    for r in line_dedup.seen_twice(docs.select("text"), n).collect():
        bits[r.segment] = np.frombuffer(r.bits, dtype=np.uint8)
    keys = np.concatenate([line_dedup.line_digests(x.encode())[1] for x in lines])
    hit = line_dedup._suspected(keys, bits)
    shared = np.array([i % 20 < 2 and i >= 20 for i in range(20_000)])
    assert hit[shared].all() and hit[~shared].mean() < 0.02
    want = list(dedup_rows(rows))
    monkeypatch.setattr(line_dedup, "CHUNK_KEYS", 500)
    same(line_dedup.drop_shared_lines(docs, keep=["doc_id"], made=("n_lines", "n_dropped", "kept_sha256")), want)


def test_op11_long_text_and_size_of_filters(spark):
    text = "\n".join(f"line {i % 5000} of a very long text with many of them" for i in range(200_000))
    docs = spark.createDataFrame([(i, text) for i in range(2)] + [(i, text[:5000]) for i in range(2, 6)], "doc_id long, text string")
    same(line_dedup.drop_shared_lines(docs, keep=["doc_id"], made=("n_lines", "n_dropped", "kept_sha256")), dedup_rows([(r.doc_id, r.text) for r in docs.collect()]))
    assert line_dedup.segments_for(0) == 1 and line_dedup.segments_for(10**15) == line_dedup.MAX_SEGMENTS
    assert line_dedup.segments_for(840_806_894) * line_dedup.SEGMENT_BITS >= 4 * 840_806_894 / 41


# runs


def smallest_period(w):
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def brute_runs(words):
    known = {}
    w = np.array([known.setdefault(x, len(known)) for x in words], dtype=np.int64)
    out = []
    for q in range(1, len(w) // 4 + 1):
        agree = np.concatenate([[False], w[:-q] == w[q:], [False]])
        edges = np.flatnonzero(np.diff(agree))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(6, 4 * q) and smallest_period(w[a : b + q].tolist()) == q:
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(doc, text):
    words = re.findall(SPACES, text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_op12(spark, odd):
    got = queries.op12_periodic_runs(spark, SF)
    want = [run_row(*r) for r in table(spark, "doc_id", "text")]
    assert sum(r[1] > 0 for r in want) > 50
    same(got, want)
    small = odd.where("length(text) < 70000 OR text IS NULL")
    got = periodic_runs.collapse_runs(small, keep=["doc_id"], made=periodic_runs.NAMES[:7], echo=periodic_runs.planted())
    same(got, [run_row(r.doc_id, r.text) for r in small.collect()])


def test_op12_random_words():
    random.seed(11)
    for n in range(600):
        alphabet = "ab" if n % 3 else "abc"
        words = random.choices(alphabet, k=random.randint(0, 60))
        for _ in range(random.randint(0, 3)):  # plant repeats, also inside repeats
            piece = words[: random.randint(1, 9)] * random.randint(2, 6)
            at = random.randint(0, len(words))
            words[at:at] = piece
        got = periodic_runs.find_runs(np.array([ord(x) for x in words], dtype=np.int64))
        assert got == brute_runs(words), words
        kept = periodic_runs.collapse(len(words), got)
        gone = {i for s, m, q in got for i in range(s + q, s + m)}
        assert [i for i, k in enumerate(kept) if not k] == sorted(gone)


def test_op12_words_in_pieces_ties_and_long_texts(spark, monkeypatch):
    text = ("one two\tthree\x0b" * 9 + "\x1c x\x85 ").encode() * 5
    plain = periodic_runs._measure(text, 12345, True)
    monkeypatch.setattr(periodic_runs, "PIECE", 7)
    assert periodic_runs._measure(text, 12345, True) == plain
    assert periodic_runs.top_run([(0, 8, 2), (9, 4, 1), (9, 16, 4), (3, 12, 3)]) == (0, 8, 2)
    monkeypatch.undo()
    long = "one " * 60_000 + " ".join(map(str, range(100_000))) + " a b c" * 100_000
    docs = spark.createDataFrame([(0, long), (None, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.collapse_runs(docs).collect()}
    assert [tuple(x) for x in got[0].runs] == [(0, 60_000, 1), (160_000, 300_000, 3)] and got[0].exponent_milli == 100_000_000
    assert got[0].collapsed == "one " + " ".join(map(str, range(100_000))) + " a b c"
    assert got[None].n_runs == 0 and got[None].start is None and got[None].collapsed == ""


def test_op12_columns_and_empty_table(spark, odd):
    extra = odd.where("doc_id < 9").selectExpr("doc_id", "text", "7 AS START", "8 AS echo", "9 AS c0")
    got = periodic_runs.collapse_runs(extra)
    assert got.columns == ["doc_id", "text", "echo", "c0", *periodic_runs.NAMES] and got.select("echo", "c0").distinct().collect() == [(8, 9)]
    assert periodic_runs.collapse_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(np.zeros(9, dtype=np.int64), least_periods=3)


# manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(level):
    """Levels of a tree over digests, and each leaf's siblings on its way up."""
    ways = [[] for _ in level]
    at = list(range(len(level)))
    while len(level) > 1:
        for w, i in zip(ways, at):
            run = level[8 * (i // 8) : 8 * (i // 8) + 8]
            w.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        at = [i // 8 for i in at]
        level = [digest(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0] if level else None, ways


def manifest_rows(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    low = lambda v: (v is not None, v.encode() if isinstance(v, str) else v)
    trees = {}
    for r in rows:
        seen = list(r)
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            seen[4] = lower(r[4])
        trees.setdefault(r[2], []).append((low(r[0]), leaf(*r), leaf(*seen), r[0]))
    order = sorted(trees, key=low)
    done = {g: climb([x[1] for x in sorted(trees[g])]) for g in order}
    root, top = climb([done[g][0] for g in order])
    for g, above in zip(order, top):
        for (_, own, seen, doc), way in zip(sorted(trees[g], key=lambda x: x[:3]), done[g][1]):
            folded = seen
            for left, right in [*way, *above]:
                folded = digest(left, folded, right)
            yield doc, own, done[g][0], root, digest(*(x + y for x, y in [*way, *above])), folded, folded == root


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_op13(spark, odd):
    want = list(manifest_rows(table(spark, *FIELDS)))
    assert 0.5 < sum(r[-1] for r in want) / len(want) < 1
    same(queries.op13_merkle_manifest(spark, SF), want)
    got = merkle_manifest.prove(odd, now=merkle_manifest.tampered()).drop("path")
    same(got, manifest_rows([tuple(r) for r in odd.select(*FIELDS).collect()]))


@pytest.mark.parametrize("sizes", [[0], [1], [1, 1], [8, 64, 65], [1] * 70 + [100], [513, 1]])
def test_op13_shapes(spark, sizes, monkeypatch):
    rows = [(i, "s", f"g{g:03d}", 1, f"Text {g} {i}") for g, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    for limit in (merkle_manifest.BROADCAST_BYTES, 0)[: 1 + (len(sizes) > 9)]:  # with and without broadcasts
        monkeypatch.setattr(merkle_manifest, "BROADCAST_BYTES", limit)
        out = merkle_manifest.prove(docs, now=merkle_manifest.tampered())
        same(out.drop("path"), manifest_rows(rows))
        assert out.columns == ["doc_id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified"]


def test_op13_columns_and_plan(spark, odd):
    extra = odd.selectExpr("doc_id", "text", "source", "lang", "n_chars", "1 AS leaf", "2 AS id", "3 AS `group`", "4 AS tree")
    got = merkle_manifest.prove(extra)
    assert got.where("NOT verified").count() == 0 and got.count() == odd.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_merkle_manifest"])
def test_sql_twins(spark, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    same(got.select(*columns), found.fetchall())
