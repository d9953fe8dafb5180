"""Toxicity by multiple-instance learning: a document is toxic if some sentence is.

Each sentence has a logistic score over the words in it; a document's score is the noisy-or of its sentences, and the
weights are trained through it from document labels alone. The sentence scores then say where the offence is.

Training takes at most SAMPLE_ROWS labelled documents, those with the smallest id hashes; everything else sees all rows. The
model is a table of at most VOCABULARY weights of words and stems, sent to the tasks; scoring is one narrow pass.

Defined cases: a text without words has the score of an empty document, 0; with no labels of either kind every score is the share
of toxic labels, or 0 without labels; labels that are null or other than 0 and 1 are left out; a document labelled twice
counts once, as toxic if either label says so. A very long text is one row of sentences; repeated rows each get their score.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, forget, slices, texts_of, written

#: Labelled documents that a model is fitted on, at most.
SAMPLE_ROWS = 8_000
#: Words with a weight, at most; and the training documents that a word must be in.
VOCABULARY, MIN_DOCS = 4_096, 4

_END = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Character spans between sentence ends; those without words too."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def _softplus(z):
    return np.logaddexp(0.0, z)


#: Longer words also count by their first letters, so that inflected and compound forms share what is learnt.
STEMS = (4, 5)


def traits(words: set[str]) -> set[str]:
    """The features of a sentence: its distinct words, and their stems, marked."""
    return words.union(*({f"{w[:n]}-" for w in words if len(w) > n} for n in STEMS))


class Model:
    """Weights of words and stems, and a bias; z of a sentence is the bias and the weights of its features."""

    def __init__(self, weights: dict[str, float], bias: float, constant: float | None = None):
        self.weights, self.bias, self.constant = weights, bias, constant
        self.words = {k: v for k, v in weights.items() if k[-1] != "-"}
        #: (letters, weights by stem without its mark)
        self.stems = [(n, {k[:-1]: v for k, v in weights.items() if k[-1] == "-" and len(k) == n + 1}) for n in STEMS]

    def z(self, words: set[str]) -> float:
        """Summed in an order of its own, so that equal sentences score equal."""
        total = self.bias
        if met := self.words.keys() & words:
            total += sum(self.words[w] for w in sorted(met))
        for n, known in self.stems:
            if met := known.keys() & {w[:n] for w in words if len(w) > n}:
                total += sum(known[w] for w in sorted(met))
        return total

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        low = _lower(text)
        return [(s, e, self.z(words)) for s, e in sentences(low) if (words := set(_WORD.findall(low, s, e)))]

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return noisy_or(self.z(set(words)) for part in _END.split(_lower(text)) if (words := _WORD.findall(part)))


def noisy_or(logits: Iterable[float]) -> float:
    """The chance that some sentence is toxic."""
    return 1.0 - math.exp(-sum(math.log1p(math.exp(min(60.0, z))) for z in logits))


def _lower(text: str) -> str:
    """Lower case of the same length; a few letters would change it."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def bags(text: str) -> list[set[str]]:
    """The features of each sentence that has words."""
    return [traits(set(w)) for part in _END.split(_lower(text)) if (w := _WORD.findall(part))]


#: Cells that documents are counted in, by hash of the word, to choose a vocabulary.
CELLS = 1 << 20


def _cells(words: set[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.int64, count=len(words)) % CELLS


def document_cells(text: str) -> np.ndarray:
    """The distinct cells of a document's features."""
    return np.unique(_cells(set().union(*bags(text))))


def choose_cells(cells: np.ndarray, seen: np.ndarray, toxic: np.ndarray, share: float, vocabulary: int, min_docs: int) -> np.ndarray:
    """True for the cells that tell most, by the standard score of the toxic documents among those that have one. seen, toxic: documents by cell."""
    surprise = np.where(seen >= min_docs, np.abs(toxic - seen * share) / np.sqrt(seen * share * (1 - share) + 1e-9), -1.0)
    best = np.lexsort((cells, -surprise))[:vocabulary]
    chosen = np.zeros(CELLS, dtype=bool)
    chosen[cells[best[surprise[best] >= 0]]] = True
    return chosen


def known_bags(text: str, chosen: np.ndarray) -> list[list[str]]:
    """The features of each sentence that are in chosen cells, in order."""
    out = []
    for s in bags(text):
        words = sorted(s)
        out.append([w for w, c in zip(words, chosen[_cells(words)], strict=True) if c])
    return out


def optimise(documents: Iterable[list[list[str]]], labels: list[int], rounds: int = 200, decay: float = 3e-4) -> Model:
    """Full-batch Adam on the noisy-or likelihood of documents as sentences of features."""
    y = np.asarray(labels, dtype=float)
    share = y.mean()
    index: dict[str, int] = {}
    word, sentence, doc = array("q"), array("q"), array("q")
    for k, one in enumerate(documents):
        for words in one:
            for w in words:
                word.append(index.setdefault(w, len(index)))
                sentence.append(len(doc))
            doc.append(k)
    word, sentence, doc = (np.asarray(x, dtype=np.int64) for x in (word, sentence, doc))
    n_sent, n_doc = len(doc), len(y)
    theta = np.zeros(len(index) + 1)
    theta[-1] = math.log(max(1e-6, -math.log1p(-min(share, 0.95)) / max(1.0, n_sent / n_doc)))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(sentence, theta[word], n_sent)
        total = np.bincount(doc, _softplus(z), n_doc)
        # of the loss by the sum of softplus: 1 for a clean document, -1/(exp(sum)-1) for a toxic one
        outer = np.where(y > 0, -1.0 / np.expm1(np.clip(total, 1e-9, 50.0)), 1.0)
        dz = np.clip(outer[doc], -50, 50) / (1.0 + np.exp(-z))
        grad = np.append(np.bincount(word, dz[sentence], len(index)), dz.sum()) / n_doc
        grad[:-1] += decay * theta[:-1]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        theta -= 0.1 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
    return Model({w: float(theta[i]) for w, i in index.items() if abs(theta[i]) > 1e-3}, float(theta[-1]))


def _one_kind(y: np.ndarray) -> Model | None:
    return Model({}, 0.0, float(y.mean()) if len(y) else 0.0) if len(y) == 0 or y.min() == y.max() else None


def train(texts: Iterable[str], labels: list[int], vocabulary: int = VOCABULARY, min_docs: int = MIN_DOCS, rounds: int = 200, decay: float = 3e-4) -> Model:
    """A model of texts at hand; gone through twice."""
    y = np.asarray(labels, dtype=float)
    if one := _one_kind(y):
        return one
    seen, toxic = np.zeros(CELLS), np.zeros(CELLS)
    for t, label in zip(texts, labels, strict=True):
        at = document_cells(t)
        seen[at] += 1
        toxic[at] += label
    chosen = choose_cells(np.arange(CELLS), seen, toxic, y.mean(), vocabulary, min_docs)
    return optimise((known_bags(t, chosen) for t in texts), labels, rounds, decay)


#: Hashes that order a sample are cut to so many bits.
ORDER_BITS = 40


def labelled_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", usable=None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled ids, in the order of a hash of the id; the same whatever the partitioning.

    Of many labels only those with hashes low enough for four times the rows are put in order, so that what meets in one task does not grow with them.
    """
    usable = F.lit(True) if usable is None else usable
    few = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    order = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << ORDER_BITS))
    few = few.where(usable).groupBy("id").agg(F.max("y").alias("y")).withColumn("place", order)
    total = few.count()
    if total > 8 * rows:
        low = few.where(F.col("place") < (4 * rows << ORDER_BITS) // total)
        few = low if low.limit(rows).count() == rows else few
    return few.orderBy("place", "id").limit(rows).drop("place")


def fold(id_col="id", parts: int = 5):
    """crc32 of the id as text, by parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


#: Parts that a sample is dealt to.
SAMPLE_PARTS = 16


def sample_texts(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple = ()) -> DataFrame:
    """The sample's documents (id, y, t and others), as a table; the sample is small by its limit."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), *others)
    # a repeated id gives one row, that of the smallest text
    one = F.min(F.struct("t", *(c for c in rows.columns if c not in ("id", "t")))).alias("one")
    return written(rows.join(F.broadcast(sample), "id").groupBy("id", "y").agg(one).select("id", "y", "one.*").repartition(SAMPLE_PARTS, "id"), "sample")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", usable=None, rows: int = SAMPLE_ROWS) -> Model:
    """A model of a labelled sample. Features are made in the tasks; what comes to the driver is counts by cell and the features of the vocabulary."""
    sample = sample_texts(docs, labelled_sample(labels, label_col, id_col, usable, rows), id_col, text_col)
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if total == 0 or toxic in (0, total):
        forget(sample)
        return Model({}, 0.0, toxic / total if total else 0.0)

    def cells(batches):
        for piece in slices(batches, 0):
            made = [document_cells(t.decode("utf-8", "replace")) for t in texts_of(piece.column(0))]
            label = np.repeat(np.asarray(piece.column(1)), [len(x) for x in made])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made)), pa.array(label.astype(np.int32))], names=["cell", "y"])

    counted = sample.select("t", "y").mapInArrow(cells, "cell long, y int").groupBy("cell").agg(F.count("*").alias("seen"), F.sum("y").alias("toxic")).toArrow()
    chosen = choose_cells(*(np.asarray(counted[c]).astype(np.int64) for c in ("cell", "seen", "toxic")), toxic / total, VOCABULARY, MIN_DOCS)
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(chosen))

    def features(batches):
        known = np.unpackbits(sent.value).astype(bool)
        for piece in slices(batches, 2):
            made = [known_bags(t.decode("utf-8", "replace"), known) for t in texts_of(piece.column(2))]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(made, pa.list_(pa.list_(pa.string())))], names=["id", "y", "bags"])

    kind = T.StructType([sample.schema["id"], sample.schema["y"], T.StructField("bags", T.ArrayType(T.ArrayType(T.StringType())))])
    table = sample.select("id", "y", "t").mapInArrow(features, kind).toArrow().sort_by("id")
    forget(sample)
    return optimise((x.as_py() for x in table["bags"]), table["y"].to_pylist())


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, locate: bool = False) -> DataFrame:
    """Adds score and predicted; with locate also sentences, the spans (code points) with a score of 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def kernel(texts: list[bytes]) -> list[pa.Array]:
            strings = [t.decode("utf-8", "replace") for t in texts]
            if not locate:
                scores = [m.score(t) for t in strings]
                return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            told = [m.sentence_scores(t) if m.constant is None else [] for t in strings]
            scores = [noisy_or(z for _, _, z in x) if m.constant is None else m.constant for x in told]
            spans = [[{"start": s, "end": e, "score": 1 / (1 + math.exp(-z))} for s, e, z in x if z >= 0] for x in told]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)]

        return kernel

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    if locate:
        spot = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
        fields.append(T.StructField("sentences", T.ArrayType(spot)))
    return append_columns(docs, text_col, make, fields, keep)
