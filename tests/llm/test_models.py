"""Learned operators: held-out accuracy, and odd tables."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwarden.llm import lm_scoring, quality_classifier, queries, toxicity

from .test_contracts import ODD

SF = "/root/testdata/sf0.1"


def accuracy(spark, df, label):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = df.where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    y, p = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    return (p == y).mean(), (p[y == 1].mean() if (y == 1).any() else 1.0), (1 - p[y == 0]).mean()


def test_op2_held_out(spark):
    df = queries.op2_toxicity(spark, SF).cache()
    assert df.where("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").count() == 0
    rows = df.select("doc_id", "held_out").limit(500).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    right, found, clean = accuracy(spark, df, "toxic")
    assert right > 0.93 and clean > 0.97


def test_op6_held_out(spark):
    df = queries.op6_quality_classifier(spark, SF).cache()
    assert df.where("score < 0 or score > 1 or (score >= 0.5) <> (predicted = 1)").count() == 0
    rows = df.select("doc_id", "held_out").limit(500).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right, found, low = accuracy(spark, df, "quality")
    assert right > 0.93


def test_toxic_sentences_are_located(spark):
    clean = [f"A quiet day number {i}. We went home. The end of it." for i in range(200)]
    bad = [f"A quiet day number {i}. You are a vile wretch. The end of it." for i in range(60)]
    model = toxicity.train(clean + bad, [0] * 200 + [1] * 60)
    df = spark.createDataFrame([(1, "Home. You are a VILE one! Done."), (2, "Home. Done."), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, model, locate=True).collect()}
    assert got[1].predicted == 1 and got[2].predicted == got[3].predicted == got[4].predicted == 0
    assert got[3].score == got[4].score == 0.0
    assert ["Home. You are a VILE one! Done."[s["start"] : s["end"]].strip() for s in got[1].sentences] == ["You are a VILE one!"]


def test_models_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b", 3), (None, None, None), (2, "c", 1), (2, "c", 1)], "doc_id long, text string, n_chars long")
    for rows, want in (([], 0.0), ([(1, 1), (2, 1), (None, 0), (2, None), (1, 7)], 1.0)):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
        assert [r.score for r in got] == [want] * 4
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality_classifier.score_documents(docs, quality_classifier.fit(docs, labels)).collect()
    assert [r.score for r in got] == [0.5] * 4


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    m = quality_classifier.Machine(buckets=30, rank=3)
    m.w, m.w0 = rng.normal(size=m.w.shape), 0.3
    rows = [(rng.integers(0, 30, 6), rng.normal(size=6), rng.normal(size=quality_classifier.N_STATS).tolist()) for _ in range(5)]
    at, value, starts = m.assemble(rows)
    fast, _ = m.raw(at, value, starts)
    for k, z in enumerate(fast):
        end = starts[k + 1] if k + 1 < len(starts) else len(at)
        i, x = at[starts[k] : end], value[starts[k] : end]
        slow = m.w0 + m.w[i] @ x + sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        assert z == pytest.approx(slow)


def test_odd_texts(spark):
    rows = [(i, t, 3) for i, t in enumerate(ODD)] + [(None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(len(ODD))], "doc_id long, y int")
    for module in (toxicity, quality_classifier):
        got = module.score_documents(docs, module.fit(docs, labels, "y")).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    models = lm_scoring.fit(docs, labels.where("y = 1"))
    assert len(lm_scoring.score_documents(docs, models).collect()) == len(rows)


def test_op3_against_plain_counts(spark):
    docs = [(1, "a b a b c"), (2, "a b"), (3, "c c c"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    for limit in (0, 100):
        models = lm_scoring.fit(df, targets, broadcast_ids=limit)
        got = {r.doc_id: r for r in lm_scoring.score_documents(df, models).collect()}
        assert got[4].n_tokens == got[5].n_tokens == 0 and got[4].score == 0.0

        def loss(text, corpus):
            words = [w.split() for w in corpus]
            uni = {x: sum(w.count(x) for w in words) for x in "abc"}
            total, out, prev = sum(uni.values()), 0.0, None
            for x in text.split():
                one = (uni[x] + lm_scoring.ADD) / (total + lm_scoring.ADD * lm_scoring.N_WORDS)
                pair = sum(sum(1 for p, q in zip([None, *w], w) if (p, q) == (prev, x)) for w in words)
                before = len([w for w in words if w]) if prev is None else uni[prev]
                out -= np.log((pair + lm_scoring.DRAW * one) / (before + lm_scoring.DRAW))
                prev = x
            return out / len(text.split())

        for k, text in docs[:3]:
            want = loss(text, ["a b a b c"]) - loss(text, [t for _, t in docs if t])
            assert got[k].score == pytest.approx(want, rel=1e-4)
        assert got[1].score < got[3].score


def test_op3_separates(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    row = queries.op3_lm_scoring(spark, SF).join(labels, "doc_id").groupBy("quality").avg("score").collect()
    mean = {r[0]: r[1] for r in row}
    assert mean[1] < mean[0]


def test_sample_is_the_same_with_and_without_the_cut(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)] + [(None, 1), (5, 7)], "doc_id long, y int").repartition(7)
    few = [(r.id, r.y) for r in toxicity.labelled_sample(labels, "y", rows=100).collect()]
    many = [(r.id, r.y) for r in toxicity.labelled_sample(labels, "y", rows=3000).collect()]
    assert len(few) == 100 and len(many) == 3000 and few == many[:100]


def test_op3_tells_all_words_apart(spark):
    """Rare words keep their own counts: under 18-bit ids, some of these would share those of a frequent one."""
    ids, twins = {}, []
    for i in range(6000):
        word = hashlib.md5(str(i).encode()).hexdigest()[:12]
        other = ids.setdefault(zlib.crc32(word.encode()) & ((1 << 18) - 1), word)
        if other != word:
            twins.append((other, word))
    assert twins
    often, rare = twins[0]
    docs = [(i, f"{often} stands here") for i in range(50)] + [(50, f"{rare} stands"), (51, f"a {rare}"), (52, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    targets = spark.createDataFrame([(50,), (51,)], "doc_id long")
    got = {r.doc_id: r for r in lm_scoring.score_documents(df, lm_scoring.fit(df, targets)).collect()}
    texts = [t.split() for _, t in docs if t]
    total = sum(map(len, texts))
    one = lambda n: (n + lm_scoring.ADD) / (total + lm_scoring.ADD * lm_scoring.N_WORDS)
    want = -np.log((1 + lm_scoring.DRAW * one(2)) / (len(texts) + lm_scoring.DRAW)) - np.log((1 + lm_scoring.DRAW * one(51)) / (2 + lm_scoring.DRAW))
    assert got[50].background_loss == pytest.approx(want / 2, rel=1e-6)
    # documents that the models are not of
    new = spark.createDataFrame([(7, f"{rare} stands"), (8, "unseen"), (9, "")], "doc_id long, text string")
    far = {r.doc_id: r for r in lm_scoring.score_documents(new, lm_scoring.fit(df, targets)).collect()}
    assert far[7].background_loss == pytest.approx(got[50].background_loss, rel=1e-9) and far[7].score == pytest.approx(got[50].score, rel=1e-9)
    assert far[8].background_loss > far[7].background_loss and far[9].n_tokens == 0


def test_op2_query_is_the_plain_form(spark):
    """Scores from the weights, sentence by sentence, by the product of the chances of being clean."""
    import re

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels, usable=toxicity.fold("id", 5) != 0)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op2_toxicity(spark, sf).collect():
        clean, spans, at = 1.0, [], 0
        for m in re.finditer(r"[^.!?\n]*(?:[.!?\n]+|\Z)", texts[r.doc_id]):
            words = {w for w in re.findall(r"[^\W_]+", m.group().lower())}
            if words:
                z = model.bias + sum(model.weights.get(x, 0.0) for x in words | {w[:4] + "-" for w in words if len(w) > 4} | {w[:5] + "-" for w in words if len(w) > 5})
                clean *= 1 - 1 / (1 + np.exp(-z))
                if z >= 0:
                    spans.append(f"{m.start()}:{m.end()}")
        assert r.score == pytest.approx(1 - clean, abs=1e-9) and r.sentences == ",".join(spans)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op2_fit_in_tasks_is_the_local_fit(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("y")), "doc_id").orderBy("doc_id").collect()
    here, there = toxicity.train([r.text or "" for r in rows], [r.y for r in rows]), toxicity.fit(docs, labels)
    assert here.weights.keys() == there.weights.keys() and here.bias == pytest.approx(there.bias, abs=1e-9)
    assert all(there.weights[w] == pytest.approx(x, abs=1e-9) for w, x in here.weights.items())


def test_op6_query_is_the_plain_form(spark):
    """All pairs of features, document by document."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = quality_classifier.fit(docs, labels, usable=toxicity.fold("id", 3) != 1)
    rows = {r.doc_id: r for r in docs.collect()}
    for r in queries.op6_quality_classifier(spark, sf).collect():
        at, value, stats = quality_classifier.features((rows[r.doc_id].text or "").encode(), rows[r.doc_id].n_chars, m.buckets)
        if len(at) > 300:
            continue
        stats = np.clip((np.array(stats) - m.mean) / m.scale, -5, 5)
        i, x = [*range(m.buckets, m.buckets + len(stats)), *at], [*stats, *value]
        v = m.v[i] * np.array(x)[:, None]
        z = m.w0 + float(m.w[i] @ np.array(x)) + sum(float(v[k + 1 :].sum(axis=0) @ v[k]) for k in range(len(i)))
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -40, 40))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
