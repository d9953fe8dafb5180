"""Files in parts: no file is put together in one row, and lines are those of the whole."""

import random

import pytest
from pyspark.sql import functions as F

from gridwarden.functions.run import apply
from gridwarden.functions.tables import written
from gridwarden.operators import lines as L
from gridwarden.operators import segments as S
from gridwarden.plans import registry

SF = "/root/testdata/sf0.001"


def test_lines_of_parts_are_those_of_the_whole(spark):
    rng = random.Random(3)
    part = lambda: "".join(rng.choice(["\n", "a b", "// file: x.js\n", "  ", "\r", "\n\n", ""]) for _ in range(rng.randrange(6)))
    rows = [(doc, place * 7 - 300, part()) for doc, n in ((1, 400), (2, 1), (3, 37), (-1, 150)) for place in range(n)]
    parts = written(spark.createDataFrame(rows, "doc_id long, place long, part string").repartition(5), "given")
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x.part), "\n").alias("code"))
    want = apply(L.parse, files=whole)
    got = S.parse_parts(parts, 16).drop("seg")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert dict(got.dtypes) == dict(want.dtypes)


@pytest.mark.parametrize("name", ["large_lines", "large_dead"])
def test_large_files_are_never_one_row(spark, monkeypatch, name):
    monkeypatch.setattr(S, "parse", lambda *a, **k: pytest.fail("a file was put together"))
    assert registry.QUERIES[name](spark, SF).count()
