"""The pipeline, stage by stage and as a whole."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from gridwarden.llm import queries, simhash, toxicity
from gridwarden.llm.common import as_read, placed, read

from . import brute
from .test_contracts import same

SF = "/root/testdata/sf0.01"


def test_whole_run(spark):
    docs = read(spark, SF, "documents")
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        steps.append((name, docs))
    first, deduped, clean, redacted, encoded = (d for _, d in steps)
    columns = read(spark, SF, "documents").columns
    assert all(d.columns == columns for d in (first, deduped, clean, redacted))
    model = toxicity.fit(read(spark, SF, "documents"), read(spark, SF, "labels"), usable=toxicity.fold("id", 5) != 0)
    want = [r.doc_id for r in toxicity.score_documents(read(spark, SF, "documents"), model).where("predicted = 0").collect()]
    assert sorted(r.doc_id for r in first.collect()) == sorted(want)
    rows = sorted((r.doc_id, r.text) for r in first.collect())
    near_copies_went([r.doc_id for r in deduped.collect()], [k for k, _ in rows], brute.similar_groups([t for _, t in rows]))
    one = brute.contamination_index([(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()])
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in deduped.collect() if not one(r.text)[-1])
    assert redacted.count() == clean.count() == encoded.count()
    for r in redacted.collect():
        assert brute.personal(r.text)[:4] == (0, 0, 0, 0)
        assert r.n_chars == len(r.text)
    same(encoded.select("doc_id", F.size("ids").cast("long")), [(r.doc_id, r.n_tokens) for r in encoded.collect()])
    same(queries.pipeline(spark, SF).select("doc_id", "ids_sha256"), [(r.doc_id, r.ids_sha256) for r in encoded.collect()])


def near_copies_went(kept, ids, groups):
    """Only rows of groups went, one row of each stayed, and nearly all others went: rows are in the order of their ids."""
    want = {k for i, k in enumerate(ids) if groups[i] == i}
    assert want <= set(kept) <= set(ids) and len(kept) == len(set(kept))
    assert len(ids) - len(kept) >= 0.9 * (len(ids) - len(want))


def test_near_copies_from_a_similarity_of_four_fifths(spark):
    """Texts with words changed, in chains and around a middle; short ones too."""
    random.seed(9)
    texts = []
    for n in (12, 40, 200, 900):
        for _ in range(25):
            base = [f"w{random.randrange(10**6)}" for _ in range(n)]
            texts.append(" ".join(base))
            for share in (0.005, 0.01, 0.015, 0.02, 0.03, 0.06):
                texts.append(" ".join(f"x{random.randrange(10**6)}" if random.random() < share else w for w in base))
    texts += ["", None, " ", "one two", "One  two", "one two three"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, FP double").repartition(5)
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns
    near_copies_went([r.doc_id for r in got.collect()], list(range(len(texts))), brute.similar_groups(texts))


def test_rows_of_files_and_of_queries_are_told_apart_alike(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, text if i % 3 else f"{text} {i} {'y' * i}") for i in range(40)], "doc_id long, text string")
    docs.repartition(4).write.parquet(str(tmp_path / "docs"))
    back = spark.read.parquet(str(tmp_path / "docs"))
    assert as_read(back.where("doc_id > 3").select("text", "doc_id")) and not as_read(docs) and not as_read(back.join(docs, "doc_id"))
    kept = [sorted(r.doc_id for r in simhash.deduplicate(d).collect()) for d in (docs, back, back.select("text", F.col("doc_id")), back.join(docs.select("doc_id"), "doc_id"))]
    assert kept[0] == kept[1] == kept[2] == kept[3]
    assert placed(back, "rows").select("file", "place").distinct().count() == 40


def test_odd_documents_go_through(spark):
    rows = [(1, "one two three", "en", "s", 13, 5.0), (1, "one two three", "en", "s", 13, 5.0), (None, None, None, None, None, None), (2, "", "en", "s", 0, 1.0), (4, "mail a@b.co now", "en", "s", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2, 4]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF).cache()
    assert empty.count() == 0


def test_groups_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text + (" more" if i % 2 else ""), "x") for i in range(50)] + [(99, "something else entirely", "y")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, kept_id string"), width=3)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 99]


def test_null_and_repeated_ids_are_not_one_document(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcde"]
    rows = [(None, texts[0], 0), (None, texts[1], 1), (7, texts[2], 2), (7, texts[3], 3), (None, texts[2], 4), (9, texts[4], 5), (8, texts[4], 6)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, row int"), width=3)
    assert sorted(r.row for r in kept.collect()) == [0, 1, 2, 3, 6]


def test_passages_are_cut_out_of_long_documents(spark):
    item = max((r.text for r in read(spark, SF, "benchmark").collect()), key=len)
    own = " ".join(f"own{i}" for i in range(40 * len(item.split())))
    docs = spark.createDataFrame([(1, f"{own} {item} last", 5), (2, "short", 9), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()}
    assert got == {1: (f"{own} last", len(own) + 5), 2: ("short", 9), 3: (None, None)}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """A text in the middle and many around it, some of them too far from it but near others; in blocks and by pairs."""
    random.seed(11)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{random.randrange(10**6)}" if random.random() < random.choice((0.01, 0.02, 0.045)) else w for w in base) for _ in range(160)]
    monkeypatch.setattr(simhash, "LARGE_GROUP", 20)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in simhash.deduplicate(docs).collect()]
    near_copies_went(kept, list(range(len(texts))), brute.similar_groups(texts))
    assert len(kept) < 100
