"""Cross-entropy difference between matched n-gram models of a target and of the background.

Both models are bigram models, smoothed towards unigrams, over all words: a word is its 64-bit hash, a bigram a 64-bit mix of two. Every token of the
corpus is counted, and no table is of a fixed size. A document's score is the mean per-token difference, target minus background:
lower is closer to the target.

Scale: documents are dealt to chunks by their place in the files, which a task that runs again or a new plan does not change. Each task sends the distinct words and pairs of its chunks with their counts, packed by share of
the keys; the shares, which become more with the input, are summed apart, and the totals go back to each chunk in the order of its keys. Then a chunk has all
that its documents need. Nothing is gathered on the driver; a word or pair comes once a chunk, so that no frequent one is a hot key.

Defined cases: a text without words has zero tokens, cross entropies and score; without target documents the target model is flat;
a null id is never a target; repeated rows count as often as they come. A very long text is scored in one go, in its chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, placed, slices, small_enough, texts_of, without

#: Words that additive smoothing sets something aside for.
N_WORDS = 1 << 18
#: Additive smoothing of unigrams, and the pseudo-count that draws a bigram to its unigram.
ADD, DRAW = 0.1, 4.0
#: Target ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Documents that share what they learn of the corpus.
CHUNK_DOCS = 4096
#: Tokens that a task holds before it counts them, and distinct keys before it sends them.
HELD_TOKENS, HELD_KEYS = 1 << 19, 1 << 21

_START, _TOTAL = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)  # count documents with words, and tokens
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)
_S = np.uint64(32)


def ids_of(text: bytes) -> np.ndarray:
    """Hashes of the words of a text."""
    words = text.translate(WORDS).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def pairs_of(ids: np.ndarray) -> np.ndarray:
    """The key of each word with the one before it; the first follows a start mark."""
    before = np.empty_like(ids)
    before[:1], before[1:] = _START, ids[:-1]
    with np.errstate(over="ignore"):
        mixed = before * _C1 + (ids ^ (ids >> _S)) * _C2
        mixed = (mixed ^ (mixed >> _S)) * _C3
    return mixed ^ (mixed >> _S)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of the rows of counts (target, background)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts[:, order], first, axis=1) if len(keys) else counts


class Counts:
    """How often each word and pair occurs in target documents and in all."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, dtype=np.uint64), np.zeros((2, 0), dtype=np.int64)
        self.held: tuple[list, list] = ([], [])
        self.n_held = 0
        self.marks = np.zeros((2, 2), dtype=np.int64)  # of target documents and all: start marks, tokens

    def add(self, ids: np.ndarray, hit: bool) -> None:
        if not len(ids):
            return
        self.held[not hit].extend((ids, pairs_of(ids)))
        self.marks[0 if hit else 1 :] += (1, len(ids))
        self.n_held += len(ids)
        if self.n_held >= HELD_TOKENS:
            self.settle()

    def settle(self) -> None:
        keys, counts = [self.keys], [self.counts]
        for k in (0, 1):
            if self.held[k]:
                met, n = np.unique(np.concatenate(self.held[k]), return_counts=True)
                keys.append(met)
                counts.append(np.stack([n if k == 0 else np.zeros_like(n), n]))
                self.held[k].clear()
        if self.marks.any():
            keys.append(np.array([_START, _TOTAL]))
            counts.append(self.marks.copy())
            self.marks[:] = 0
        if len(keys) > 1:
            self.keys, self.counts = _summed(np.concatenate(keys), np.concatenate(counts, axis=1))
        self.n_held = 0


@dataclass
class Models:
    """What the models are of. They are counted when documents are scored, as their tables are as large as the corpus."""

    docs: DataFrame
    rows: DataFrame  # all columns of docs as c0, c1 and on, hit, chunk


def _numbered(docs: DataFrame) -> DataFrame:
    """The columns as c0, c1 and on, and the chunk: CHUNK_DOCS rows that stand together in a file, the same ones each time."""
    rows = placed(docs, "corpus")
    chunk = F.xxhash64("file", F.floor(F.col("place") / CHUNK_DOCS)).bitwiseAND(F.lit((1 << 63) - 1))
    return rows.withColumn("chunk", chunk).drop("file", "place")


def fit(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", target_id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> Models:
    """Models of the documents whose id is in targets, and of all."""
    ids = targets.select(F.col(f"`{target_id_col}`").alias("t_id")).where("t_id is not null").distinct().withColumn("hit", F.lit(True))
    rows = _numbered(docs)
    side = F.broadcast(ids) if small_enough(ids, broadcast_ids) else ids
    rows = rows.join(side, rows[f"c{docs.columns.index(id_col)}"] == side["t_id"], "left").drop("t_id")
    return Models(docs, rows.withColumnRenamed(f"c{docs.columns.index(text_col)}", "body"))


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes, which compress where they are small."""
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _shares(rows: DataFrame) -> int:
    """Shares that keys are dealt to; a share is as large at any size of the corpus."""
    return max(256, 2 * rows.rdd.getNumPartitions())


def _count(rows: DataFrame, counted: bool, scored: bool, shares: int) -> DataFrame:
    """Rows (share, chunk, keys, counts): the words and pairs of each chunk in order, as differences, with how often they occur; counts of zero if not counted, chunk -1 if not scored."""

    def run(batches):
        chunks: dict[int, Counts] = {}

        def sent():
            for chunk, c in chunks.items():
                c.settle()
                cuts = np.searchsorted((c.keys >> _S) * np.uint64(shares) >> _S, np.arange(shares + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cuts))
                for i in range(0, len(some), 64):
                    spans = [(k, slice(cuts[k], cuts[k + 1])) for k in some[i : i + 64].tolist()]
                    keys = [_packed(np.diff(c.keys[x], prepend=np.uint64(0))) for _, x in spans]
                    counts = [_packed((c.counts[:, x] * counted).ravel()) for _, x in spans]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in spans], pa.int64()), pa.array([chunk] * len(spans), pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["share", "chunk", "keys", "counts"])
            chunks.clear()

        for piece in slices(batches, 2):
            for chunk, hit, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts_of(piece.column(2)), strict=True):
                chunks.setdefault(chunk if scored else -1, Counts()).add(ids_of(text), bool(hit))
            if sum(len(c.keys) + 2 * c.n_held for c in chunks.values()) > HELD_KEYS:
                yield from sent()
        yield from sent()

    return rows.select("chunk", "hit", "body").mapInArrow(run, "share long, chunk long, keys binary, counts binary")


def _totals(table: pa.Table) -> pa.Table:
    """Of one share: rows (chunk, share, totals), the sums over all chunks for the keys that the chunk has, in order."""
    chunks = table.column("chunk").to_pylist()
    keys = [np.cumsum(_unpacked(x).view(np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
    counts = [_unpacked(x).reshape(2, -1) for x in table.column("counts").to_pylist()]
    met, sums = _summed(np.concatenate(keys), np.concatenate(counts, axis=1))
    own: dict[int, list] = {}
    for chunk, k in zip(chunks, keys, strict=True):
        if chunk >= 0:
            own.setdefault(chunk, []).append(k)
    share = table.column("share")[0].as_py()
    totals = [_packed(sums[:, np.searchsorted(met, k[0] if len(k) == 1 else np.unique(np.concatenate(k)))].ravel()) for k in own.values()]
    return pa.Table.from_arrays([pa.array(list(own), pa.int64()), pa.array([share] * len(own), pa.int64()), pa.array(totals, pa.binary())], names=["chunk", "share", "totals"])


def _losses(ids: np.ndarray, first: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per-token losses in nats under target and background. ids: the words of several texts; first: where a text starts, by token."""
    pairs = np.concatenate([pairs_of(x) for x in np.split(ids, np.flatnonzero(first)[1:])])
    words, both = np.searchsorted(keys, ids), np.searchsorted(keys, pairs)
    start, total = np.searchsorted(keys, np.array([_START, _TOTAL]))
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first] = start
    out = []
    for c in counts:
        one = (c[words] + ADD) / (c[total] + ADD * N_WORDS)
        out.append(-np.log((c[both] + DRAW * one) / (c[before] + DRAW)))
    return out[0], out[1]


def score_documents(docs: DataFrame, models: Models, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, target_loss, background_loss (nats a token) and score, their difference."""
    made = [T.StructField("n_tokens", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("target_loss", "background_loss", "score"))]
    keep = without(docs.columns if keep is None else keep, (f.name for f in made))
    own = docs is models.docs
    rows = models.rows if own else _numbered(docs).withColumn("hit", F.lit(False)).withColumnRenamed(f"c{docs.columns.index(text_col)}", "body")
    shares = _shares(models.docs)
    sent = _count(rows, own, True, shares)
    if not own:
        sent = sent.unionByName(_count(models.rows, True, False, shares))
    known = sent.groupBy("share").applyInArrow(_totals, "chunk long, share long, totals binary")
    at = lambda c: "body" if c == text_col else f"c{docs.columns.index(c)}"
    sides = rows.select("chunk", "hit", "body", *(F.col(at(c)).alias(f"k{i}") for i, c in enumerate(keep)))
    names = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([*(T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep, strict=True)), *(T.StructField(f"o{i}", f.dataType) for i, f in enumerate(made))])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = list(slices(left.select(["chunk", "hit", "body"]).to_batches(), 2))
        chunk = Counts()
        for piece in pieces:
            for hit, text in zip(piece.column(1).to_pylist(), texts_of(piece.column(2)), strict=True):
                chunk.add(ids_of(text), bool(hit))
        chunk.settle()
        keys = chunk.keys
        told = sorted(zip(right.column("share").to_pylist(), right.column("totals").to_pylist(), strict=True))
        counts = np.concatenate([np.zeros((2, 0), dtype=np.int64), *(_unpacked(x).reshape(2, -1) for _, x in told)], axis=1)
        if counts.shape[1] != len(keys):
            raise RuntimeError("a chunk had other documents when it was counted")
        n, means = [], [[], [], []]
        for piece in pieces:
            ids = [ids_of(t) for t in texts_of(piece.column(2))]
            size = np.array([len(x) for x in ids])
            n.append(size)
            some = size > 0
            sums = np.zeros((3, len(size)))
            if some.any():
                starts = np.concatenate([[0], np.cumsum(size[some])[:-1]])
                first = np.zeros(size.sum(), dtype=bool)
                first[starts] = True
                a, b = _losses(np.concatenate(ids), first, keys, counts)
                sums[:, some] = np.stack([np.add.reduceat(x, starts) for x in (a, b, a - b)]) / size[some]
            for k in range(3):
                means[k].append(sums[k])
        columns = [pa.array(np.concatenate(x)) for x in (n, *means)]
        return pa.Table.from_arrays([*(left.column(x) for x in names), *columns], names=schema.names)

    out = sides.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(score, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *(F.col(f"o{i}").alias(f.name) for i, f in enumerate(made)))
