"""Maximal periodic runs of words, by a dictionary of basic factors.

For each power of two, the factors of so many words get a name, made of the names of their halves. Occurrences of a factor that follow each other within twice its length
form arithmetic progressions, and three in one propose their difference as a period; the proposals of a stretch are one, which is extended word by word to both sides.
A factor of length L tells the periods from L / 2 to L: a run of period q that holds four periods has a factor of L >= q words again after q words and not sooner, as two periods
of less than L words would make a smaller one. Only places whose factor comes again get a name at the next length, so that ordinary text is over after a few lengths.

Scale: one narrow pass, no shuffle; a text of n words takes O(n log n) time for each length, and memory of some 100 bytes a word besides its distinct words. Words are numbered piece by piece.

Defined cases: null and empty texts have no words, no runs, four nulls and hashes of nothing; a null in the echo column, and so a null id in the query, leaves the words as they are; repeated rows get equal
results; ties of the top run go to the smallest start, then the smallest period; an empty table gives no rows; a very long text is taken whole. Other columns are passed on unread, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of, without

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text, and words, that are handled at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the distinct words in order of their numbers."""
    known: dict[bytes, int] = {}
    out, at = [np.empty(0, dtype=np.int32)], 0
    while at < len(text):
        cut = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words)))
        at = end
    return np.concatenate(out), list(known)


def _stretches(places: np.ndarray, periods: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first, last, period) of consecutive places that propose one period."""
    if not len(places):
        return iter(())
    order = np.lexsort((places, periods))
    places, periods = places[order], periods[order]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (np.diff(places) != 1) | (np.diff(periods) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    return zip(places[first].tolist(), places[last].tolist(), periods[first].tolist(), strict=True)


def _agree(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from `at` on, in the direction of step, equal those a period later."""
    n = 0
    while True:
        size = max(16, period)
        a = at + step * n
        if step > 0:
            here = words[a : min(a + size, len(words) - period)]
        else:
            here = words[max(0, a - size + 1) : a + 1] if a >= 0 else words[:0]
        if not len(here):
            return n
        low = a if step > 0 else a - len(here) + 1
        differs = np.flatnonzero(here != words[low + period : low + period + len(here)])
        if len(differs):
            return n + int(differs[0] if step > 0 else len(here) - 1 - differs[-1])
        n += len(here)


def find_runs(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start and period; words: numbers. least_periods: four or more."""
    if least_periods < 4:
        raise ValueError("progressions of three factors tell runs of four periods or more")
    n, size, found = len(words), 1, set()
    at, names = np.arange(n), words.astype(np.int64)
    while len(at) and 2 * size <= n:
        order = np.argsort(names, kind="stable")
        place, name = at[order], names[order]
        gap = np.diff(place)
        again = (name[1:] == name[:-1]) & (gap * least_periods <= n)
        # three occurrences in a progression, near enough for this length to tell their difference
        near = again & (gap <= size) & (2 * gap > size)
        three = near[1:] & near[:-1] & (gap[1:] == gap[:-1])
        for first, last, q in _stretches(place[:-2][three], gap[:-1][three]):
            start = first - _agree(words, first - 1, q, -1)
            length = last + _agree(words, last, q, 1) + q - start
            if length >= max(least_words, least_periods * q):
                found.add((start, length, q))
        live = np.zeros(n, dtype=bool)
        live[place[:-1][again]] = True
        live[place[1:][again]] = True
        of = np.full(n, -1)
        of[at] = names
        at = np.flatnonzero(live[:-size] & live[size:])
        names = np.unique(of[at] * n + of[at + size], return_inverse=True)[1] if len(at) else at
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def top_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equal ones the first, then the one of the smallest period."""
    if not runs:
        return None
    share = np.array([length / q for _, length, q in runs])
    near = [runs[i] for i in np.flatnonzero(share >= share.max() * (1 - 1e-12))]
    return max(near, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def collapse(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: of each run only the first period, but for what another run takes."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def echoed(n: int, g: int) -> np.ndarray:
    """Places of words where a text of n words is made to repeat itself from word g % n on, as g says."""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    place[a:] = a + (place[a:] - a) % p
    return place


def _measure(text: bytes, g: int | None, texts: bool) -> tuple:
    words, known = word_numbers(text)
    if g is not None and len(words):
        words = words[echoed(len(words), g)]
    runs = find_runs(words)
    top = top_run(runs)
    told = hashlib.sha256()
    for run in runs:
        told.update(b"%d,%d,%d\n" % run)
    kept, left, parts = words[collapse(len(words), runs)], hashlib.sha256(), []
    for i in range(0, len(kept), PIECE):
        part = (b" " if i else b"") + b" ".join([known[w] for w in kept[i : i + PIECE].tolist()])
        left.update(part)
        if texts:
            parts.append(part)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    spans = [{"start": s, "length": m, "period": q} for s, m, q in runs]
    return len(runs), *best, told.hexdigest(), left.hexdigest(), spans, b"".join(parts).decode("utf-8", "replace")


def collapse_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, made: tuple[str, ...] = NAMES, echo: Column | None = None) -> DataFrame:
    """Adds to every document what is wanted of NAMES: the number of runs, the top run, hashes, all runs, and the text with each run cut to one period.

    echo: a whole number, or null, that makes a text repeat itself first (echoed()), which plants runs for tests.
    """
    span = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
    kinds = dict(zip(NAMES, [*[T.LongType()] * 5, T.StringType(), T.StringType(), span, T.StringType()], strict=True))
    arrow = {T.LongType(): pa.int64(), T.StringType(): pa.string(), span: pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))}
    keep = without(docs.columns if keep is None else keep, made)
    source = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)),
        (F.lit(None) if echo is None else echo).cast("long").alias("echo"),
        F.col(f"`{text_col}`").alias("body"),
    )
    schema = T.StructType([source.schema[f"c{i}"] for i in range(len(keep))] + [T.StructField(f"o{i}", kinds[m]) for i, m in enumerate(made)])
    at, k, texts = [NAMES.index(m) for m in made], len(keep), "collapsed" in made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, k + 1):
            rows = [_measure(t, g, texts) for t, g in zip(texts_of(piece.column(k + 1)), piece.column(k).to_pylist(), strict=True)]
            results = [pa.array([r[i] for r in rows], arrow[kinds[m]]) for i, m in zip(at, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(k)), *results], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *made)


def planted(id_col: str = "doc_id") -> Column:
    """The echo of the registered query: one document in ten, by the hash of its id, repeats itself."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    return F.when(h % 10 == 0, F.floor(h / 10))
