"""Near copies by sets of shingles: pages that share a repeated passage are not copies, and pairs at the limit are found."""

import random

import numpy as np
from pyspark.sql import functions as F

from gridwarden.llm import simhash
from gridwarden.llm.common import written

from . import brute
from .test_pipeline import near_copies_went


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r.doc_id for r in simhash.deduplicate(docs).collect())


def test_a_repeated_passage_makes_no_copies(spark):
    rng = random.Random(1)
    six = ["please read the terms below " * 60 + words(rng, 70) for _ in range(6)]
    menus = ["home about contact sign in " * rng.randrange(20, 200) + words(rng, rng.randrange(8, 90)) for _ in range(60)]
    same = ["please read the terms below " * k for k in (3, 60, 61)]  # the same shingles, however often
    texts = six + menus + same
    assert kept_of(spark, texts) == list(range(len(texts) - 2))


def test_lines_repeated_in_all_shares(spark):
    """Texts of which 10 to 90 % is one repeated line, and near copies of them."""
    rng = random.Random(2)
    texts = []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for _ in range(8):
            own = [f"w{rng.randrange(10**6)}" for _ in range(120)]
            line = "all our pages end with this line of words\n" * round(120 * share / (1 - share) / 9)
            texts.append(" ".join(own) + "\n" + line)
            for change in (0.004, 0.01, 0.02, 0.1):
                texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < change else w for w in own) + "\n" + line * rng.choice((1, 2)))
    groups = brute.similar_groups(texts)
    kept = kept_of(spark, texts)
    near_copies_went(kept, list(range(len(texts))), groups)
    assert len({r for r in groups.values()}) >= 40


def test_pairs_at_the_limit_are_found(spark):
    """Of pairs of a similarity of 0.8 or a little more, by themselves, so that no third text helps: how many are candidates, and that all of them are told right."""
    rng = random.Random(3)
    texts, near = [], {}
    for k in range(400):
        own = [f"w{rng.randrange(10**7)}" for _ in range(rng.choice((80, 200, 500)))]
        other = list(own)
        for _ in range(max(1, round(len(own) * rng.uniform(0.005, 0.024)))):
            other[rng.randrange(len(own))] = f"x{rng.randrange(10**7)}"
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (own, other))
        near[k] = len(a & b) / len(a | b)
        texts += [" ".join(own), " ".join(other)]
    kept = set(kept_of(spark, texts))
    gone = {k for k in near if 2 * k + 1 not in kept}
    alike = {k for k, j in near.items() if j >= 0.8}
    assert all(2 * k in kept for k in near) and gone <= alike and 100 < len(alike) < 390
    at_limit = {k for k in alike if near[k] < 0.85}
    assert len(at_limit) > 40
    assert len(gone & alike) >= 0.97 * len(alike) and len(gone & at_limit) >= 0.93 * len(at_limit)


def test_what_is_believed_unread_is_right():
    """Sets of a known similarity with 64 shingles or more: the wide fingerprints of those below 0.78 never come within SURE_BITS."""
    rng = np.random.default_rng(4)
    wrong, sure = 0, 0
    for _ in range(4000):
        n = int(rng.integers(64, 300))
        share = rng.uniform(0.5, 0.995)
        m = round(2 * n * share / (1 + share))
        pool = rng.integers(0, 1 << 63, size=2 * n - m, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:m], pool[n:]]))
        bits = int((simhash.wide_fingerprint(a)[1] != simhash.wide_fingerprint(b)[1]).sum())
        if bits <= simhash.SURE_BITS:
            sure += 1
            wrong += m / (2 * n - m) < 0.78
    assert sure > 500 and wrong == 0


def test_nodes_are_sets(spark):
    texts = ["a b c d e f g", "a b c d e f g a b c d e f g", "A  b c\nd e f g", "g f e d c b a", "", None, " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    rows = {r.id: r for r in written(simhash.wide_fingerprints(docs, "body", ["id"]), "prints").collect()}
    assert rows[0].fp == rows[2].fp != rows[1].fp and rows[3].fp != rows[0].fp and rows[4].fp == rows[5].fp == rows[6].fp
    assert rows[0].n_shingles == 3 and rows[4].n_shingles == 0 and len(rows[0].segments) == simhash.SEGMENTS


def test_middles_are_the_same_however_marks_are_dealt(spark, monkeypatch):
    """A group of near copies, copies of one text and texts apart: pairs by frames and by parts; middles by parts and by one plain aggregate."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [words(rng, 80) for _ in range(40)] + [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 150, 3)] + [" ".join(base)] * 3
    docs = spark.createDataFrame([(0, i, i, t) for i, t in enumerate(texts)], "file int, place int, id int, body string")
    nodes = written(simhash.wide_fingerprints(docs, "body", ["file", "place", "id"]).dropDuplicates(["fp"]), "nodes")
    firsts, _ = simhash.firsts_of_prints(nodes)
    seen = []
    for size in (4096, 20, 2):
        monkeypatch.setattr(simhash, "FEW_NODES", size)
        seen.append(sorted(map(tuple, simhash.pairs_with_middles(firsts, 0.8).collect())))
    assert seen[0] == seen[1] == seen[2]

    assert len(seen[0]) >= 40

    rows = spark.createDataFrame([(rng.getrandbits(63), m, 300, rng.randrange(5)) for m in range(4) for _ in range(300)], "fp long, mark long, n long, n_shared long")
    plain = rows.groupBy("mark").agg(F.array_distinct(F.array(*simhash._standing(F.col("fp")))).alias("middles"))
    for size in (7, 300):
        monkeypatch.setattr(simhash, "FEW_NODES", size)
        assert sorted(map(tuple, simhash._middles_of_parts(rows).collect())) == sorted(map(tuple, plain.collect()))
