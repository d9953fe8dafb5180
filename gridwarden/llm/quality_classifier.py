"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

    score = logistic(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])

The sum-of-squares identity makes the pairwise part linear in a document's features. Words are hashed to a fixed number of buckets,
so the model is the same size whatever the corpus: sent to the tasks once, applied in one narrow pass.

Metadata is the stated length of a document (n_chars): whether it is there, its logarithm, and how far it is from the true one.
Labels, language, source and id are never features.

Training takes at most SAMPLE_ROWS labelled documents, those with the smallest id hashes; their features are made in the tasks.

Defined cases: null and empty texts have no word features and zero statistics, and are scored like any other; null metadata is a feature of
its own; with one kind of label only, every score is that label's share, 0.5 without labels. Repeated rows each get their score; a very long text is one row of features.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, append_columns, forget, fresh, slices, texts_of
from .toxicity import labelled_sample, sample_texts

SAMPLE_ROWS = 8_000
#: Buckets for words, rank of the pairwise part.
BUCKETS, RANK = 4_096, 6

#: Fixed character sets of the structure statistics.
SYMBOLS = b"#*$%&|<>{}[]\\^~=+_@"
STOPS = b".!?"
COMMAS = b",;:"
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def statistics(text: bytes, words: list[bytes], stated: float | None) -> list[float]:
    """Structure of a text, and metadata; each about 0 to 1, or a logarithm."""
    raw = text.split()
    n, size = len(raw), max(1, len(text))
    of = lambda chars: (len(text) - len(text.translate(None, chars))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words)) / len(words) if words else 0.0
    mean = sum(map(len, raw)) / n if n else 0.0
    pairs = Counter(zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else {}
    repeated = sum(c for c in pairs.values() if c > 1) / (len(words) - 2) if pairs else 0.0
    real = len(text.decode("utf-8", "replace"))
    return [
        math.log1p(n) / 8,
        of(SYMBOLS),
        of(STOPS),
        of(COMMAS),
        of(DIGITS),
        of(UPPER),
        distinct,
        mean / 20,
        repeated,
        math.log1p(len(lines)) / 6,
        len(set(lines)) / len(lines) if lines else 0.0,
        n / len(lines) / 50 if lines else 0.0,
        sum(1 for x in raw if not x.isalpha()) / n if n else 0.0,
        sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / len(lines) if lines else 0.0,
        0.0 if stated is None else 1.0,
        math.log1p(max(0.0, stated or 0.0)) / 12,
        0.0 if stated is None else min(1.0, abs(stated - real) / max(1.0, stated, real)),
    ]


N_STATS = 17


def features(text: bytes, stated: float | None, buckets: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets of the distinct hashed words, their values (of length one together), and the statistics."""
    words = text.translate(WORDS).split()
    count = Counter(words)
    at = np.fromiter((zlib.crc32(w) for w in count), dtype=np.int64, count=len(count)) % buckets
    value = np.log1p(np.fromiter(count.values(), dtype=float, count=len(count)))
    norm = math.sqrt(float(value @ value)) or 1.0
    return at, value / norm, statistics(text, words, stated)


class Machine:
    def __init__(self, buckets: int = BUCKETS, rank: int = RANK, seed: int = 7):
        size = buckets + N_STATS
        rng = np.random.default_rng(seed)
        self.buckets, self.w0, self.constant = buckets, 0.0, None
        self.w, self.v = np.zeros(size), rng.normal(0, 0.05, (size, rank))
        self.mean, self.scale = np.zeros(N_STATS), np.ones(N_STATS)

    def assemble(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature numbers, values and the start of each row, in one run."""
        stats = np.clip((np.array([r[2] for r in rows]) - self.mean) / self.scale, -5, 5)
        extra = np.arange(self.buckets, self.buckets + N_STATS)
        at = np.concatenate([np.concatenate((extra, r[0])) for r in rows])
        value = np.concatenate([np.concatenate((s, r[1])) for s, r in zip(stats, rows, strict=True)])
        starts = np.cumsum([0, *(N_STATS + len(r[0]) for r in rows[:-1])])
        return at, value, starts

    def raw(self, at, value, starts):
        """Scores before the logistic, and the factor sums, in time linear in the features."""
        weighted = self.v[at] * value[:, None]
        total = np.add.reduceat(weighted, starts)
        square = np.add.reduceat(weighted * weighted, starts)
        line = np.add.reduceat(self.w[at] * value, starts)
        return self.w0 + line + 0.5 * (total * total - square).sum(axis=1), total

    def predict(self, rows: list[tuple]) -> np.ndarray:
        if self.constant is not None or not rows:
            return np.full(len(rows), self.constant if self.constant is not None else 0.5)
        z, _ = self.raw(*self.assemble(rows))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[tuple], labels: list[int], buckets: int = BUCKETS, rank: int = RANK, epochs: int = 12, batch: int = 256, rate: float = 0.08, decay: float = 1e-5) -> Machine:
    """Mini-batches with Adagrad steps, in an order fixed by a seed."""
    m, y = Machine(buckets, rank), np.asarray(labels, dtype=float)
    if len(y) == 0 or y.min() == y.max():
        m.constant = float(y.mean()) if len(y) else 0.5
        return m
    stats = np.array([r[2] for r in rows])
    m.mean, m.scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    m.w0 = math.log(y.mean() / (1 - y.mean()))
    size = buckets + N_STATS
    gw, gv = np.full(size, 1e-3), np.full((size, rank), 1e-3)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            at, value, starts = m.assemble([rows[k] for k in pick])
            z, total = m.raw(at, value, starts)
            miss = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
            of = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(at))))
            dx = miss[of] * value
            dw = np.bincount(at, dx, size) + decay * m.w
            dv = np.empty_like(m.v)
            for f in range(rank):
                dv[:, f] = np.bincount(at, dx * (total[of, f] - m.v[at, f] * value), size)
            dv += decay * m.v
            m.w0 -= rate * miss.sum()
            gw += dw * dw
            gv += dv * dv
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= 0.3 * rate * dv / np.sqrt(gv)
    return m


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", usable=None, rows: int = SAMPLE_ROWS) -> Machine:
    stated = F.col(f"`{size_col}`").cast("double").alias("stated") if size_col in docs.columns else F.lit(None).cast("double").alias("stated")
    sample = sample_texts(docs, labelled_sample(labels, label_col, id_col, usable, rows), id_col, text_col, (stated,))

    def hashed(batches):
        for piece in slices(batches, 2):
            made = [features(t, x, BUCKETS) for t, x in zip(texts_of(piece.column(2)), piece.column(3).to_pylist(), strict=True)]
            lists = [pa.array([x[0] for x in made], pa.list_(pa.int64())), pa.array([x[1] for x in made], pa.list_(pa.float64())), pa.array([x[2] for x in made], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *lists], names=kind.names)

    number = lambda t: T.ArrayType(t())
    kind = T.StructType([sample.schema["id"], sample.schema["y"], T.StructField("at", number(T.LongType)), T.StructField("value", number(T.DoubleType)), T.StructField("stats", number(T.DoubleType))])
    table = sample.select("id", "y", "t", "stated").mapInArrow(hashed, kind).toArrow().sort_by("id")
    forget(sample)
    made = [(np.asarray(a.values), np.asarray(v.values), s.as_py()) for a, v, s in zip(table["at"], table["value"], table["stats"], strict=True)]
    return train(made, table["y"].to_pylist())


def score_documents(docs: DataFrame, model: Machine, text_col: str = "text", size_col: str = "n_chars", keep: list[str] | None = None) -> DataFrame:
    """Adds score and predicted to every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = docs.columns if keep is None else keep
    both = fresh("text_and_size", docs.columns)
    # the stated length goes before the text, in one column for the kernel
    stated = F.col(f"`{size_col}`").cast("double").cast("string") if size_col in docs.columns else F.lit(None).cast("string")
    packed = docs.withColumn(both, F.concat(F.coalesce(stated, F.lit("")), F.lit("\n"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))

    def make():
        m = sent.value

        def kernel(texts: list[bytes]) -> list[pa.Array]:
            rows = []
            for t in texts:
                size, _, body = t.partition(b"\n")
                rows.append(features(body, float(size) if size else None, m.buckets))
            p = m.predict(rows)
            return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

        return kernel

    return append_columns(packed, both, make, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)
