"""Benchmark decontamination by a generalised suffix automaton of word sequences.

The automaton holds every run of consecutive words of every test item; words that no item has end a match at once.
Streaming a document's words through it tracks the longest run that ends at each word. Where that run is as long as a
window, its words are hit, and the state that holds the window names the items which have it.

Scale: with a benchmark of one share, documents never move: one narrow pass. A larger one is gone through in shares of a bounded number of words, one automaton
each; a share's hits are written before the next starts, so that a task has one automaton whatever the size of the benchmark.

Defined cases: null or empty texts have no words and no hits; an item of fewer words than a window, but not none, is one window; items
without words have none; repeated items count once; an item id that repeats names one item with all its texts. A very long text is streamed; repeated rows each
get their row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, append_columns, forget, placed, slices, texts_of, without, written

WINDOW = 13
#: Words of test items in one automaton; at some 900 bytes a word, 90 MB a task.
SHARE_WORDS = 100_000


class SuffixAutomaton:
    """Generalised suffix automaton over words, with the items of each window at the state that holds it."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, list[str]] = {}
        #: at the state of a whole short item: its length and its ids
        self.short: dict[int, dict[int, list[str]]] = {}
        rows = sorted({(str(k), tuple(w)) for k, w in items if w})
        for _, words in rows:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for key, words in rows:
            self._mark(key, words)
        self.least = min((min(len(w), window) for _, w in rows), default=window)
        self.words = frozenset(w for _, ws in rows for w in ws)
        #: nearest state up the suffix links that has a short item
        self.up = [-1] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.up[v] = v if v in self.short else self.up[self.link[v]]

    def _state(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """A state of its own for the sequences of q that come from p."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _mark(self, key: str, words: tuple[bytes, ...]) -> None:
        state = 0
        for i, w in enumerate(words, 1):
            state = self.next[state][w]
            if i >= self.window:
                at = self.holding(state, self.window)
                owners = self.items.setdefault(at, [])
                if not owners or owners[-1] != key:
                    owners.append(key)
        if len(words) < self.window:
            self.short.setdefault(self.holding(state, len(words)), {}).setdefault(len(words), []).append(key)

    def holding(self, state: int, length: int) -> int:
        """The state of the last `length` words of what `state` stands for."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive) that windows cover, merged, and the items whose windows occur."""
        found: list[list[int]] = []
        names: set[str] = set()

        def add(start: int, end: int) -> None:
            while found and found[-1][1] >= start:
                start = min(start, found.pop()[0])
            found.append([start, end])

        known = bytes(map(self.words.__contains__, words))
        for run in re.finditer(b"\x01{%d,}" % self.least, known):
            state = length = 0
            for i in range(*run.span()):
                w = words[i]
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                state = self.next[state].get(w, 0)
                length = length + 1 if state else 0
                if length >= self.window:
                    add(i + 1 - self.window, i + 1)
                    names.update(self.items.get(self.holding(state, self.window), ()))
                v = self.up[state] if state else -1
                while v > 0:
                    for n, keys in self.short[v].items():
                        if n <= length:
                            add(i + 1 - n, i + 1)
                            names.update(keys)
                    v = self.up[self.link[v]]
        return [tuple(x) for x in found], names


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and out[-1][1] >= s:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def shares(items: DataFrame, id_col: str, text_col: str, share_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The test items in lists of about share_words words, by a hash of the id. More than one are dealt to a table first, of which each reads its part."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("k"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).where("k is not null")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // (2 * share_words)))  # a word and what follows it are two characters at least
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("k"), F.lit(n)))
    if n > 1:
        dealt = written(dealt, "items", by="share")
    for i in range(n):
        yield [(r.k, r.t.encode()) for r in dealt.where(F.col("share") == i).toLocalIterator()]
    forget(dealt)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _found(rows: DataFrame, auto, text: str, keep: list[str]) -> DataFrame:
    """Adds spans and items of one automaton."""

    def make():
        a = auto.value

        def kernel(texts: list[bytes]) -> list[pa.Array]:
            met = [a.spans(alnum_words(t)) for t in texts]
            spans = [[{"start": s, "end": e} for s, e in x] for x, _ in met]
            return [pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(x) for _, x in met], pa.list_(pa.string()))]

        return kernel

    return append_columns(rows, text, make, [T.StructField("spans", _SPANS), T.StructField("items", T.ArrayType(T.StringType()))], keep)


def find_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    share_words: int = SHARE_WORDS,
    keep: list[str] | None = None,
    cut_words: int | None = None,
) -> DataFrame:
    """Adds n_words, hits (binary: pairs of 32-bit word positions, end exclusive), n_hit and items to every row.

    With cut_words also n_cut, the words in hit spans of at least so many words, and left, the text without these spans; null if nothing is cut.
    A benchmark of several shares is gone through one share after the other, each writing what it hits, so that no task has more than one automaton.
    """
    made = {"n_words": T.LongType(), "hits": T.BinaryType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType())}
    if cut_words is not None:
        made |= {"n_cut": T.LongType(), "left": T.StringType()}
    keep = without(docs.columns if keep is None else keep, made)
    context = docs.sparkSession.sparkContext
    ready = (context.broadcast(SuffixAutomaton(((k, alnum_words(t)) for k, t in share), window)) for share in shares(benchmark, item_col, item_text_col, share_words))
    first, second = next(ready), next(ready, None)
    if second is None:
        named = [f"c{i}" for i in range(len(keep))]
        rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, named, strict=True)), F.col(f"`{text_col}`").alias("body"))
        told = lambda: first.value.spans
    else:
        rows = placed(docs, "rows")
        named, text = [f"c{docs.columns.index(c)}" for c in keep], f"c{docs.columns.index(text_col)}"
        tables = [written(_found(rows, auto, text, ["file", "place"]).where(F.size("spans") > 0), "hits") for auto in chain((first, second), ready)]
        hits = reduce(DataFrame.unionByName, tables).groupBy("file", "place").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        met = written(hits, "hits")
        for done in tables:
            forget(done)
        rows = rows.join(met, ["file", "place"], "left").select(*named, F.col(text).alias("body"), "spans", "items")
        told = None
    k = len(named)
    schema = T.StructType([*(T.StructField(f"k{i}", rows.schema[n].dataType) for i, n in enumerate(named)), *(T.StructField(f"o{i}", t) for i, t in enumerate(made.values()))])
    arrow = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string()][: len(made)]

    def one(text: bytes, spans: list[tuple[int, int]], items: list[str]) -> tuple:
        out = [len(alnum_words(text)), np.array(spans, dtype="<i4").tobytes(), sum(e - s for s, e in spans), items]
        if cut_words is not None:
            far = [(s, e) for s, e in spans if e - s >= cut_words]
            out += [sum(e - s for s, e in far), left_of(text.decode("utf-8", "replace"), far) if far else None]
        return out

    def run(batches):
        spans_of = told() if told else None
        for piece in slices(batches, k):
            texts = texts_of(piece.column(k))
            if spans_of:
                met = [(spans, sorted(items)) for spans, items in (spans_of(alnum_words(t)) for t in texts)]
            else:
                met = [(_merge([(x["start"], x["end"]) for x in s or []]), i or []) for s, i in zip(piece.column(k + 1).to_pylist(), piece.column(k + 2).to_pylist(), strict=True)]
            columns = zip(*(one(t, *m) for t, m in zip(texts, met, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(k)), *(pa.array(c, t) for c, t in zip(columns, arrow, strict=True))], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"o{i}").alias(n) for i, n in enumerate(made)))


def contaminated(n_hit, n_words, one_in: int = 20):
    """The rule for a whole document: some hit, and at least one word in so many."""
    return (n_hit > 0) & (F.lit(one_in) * n_hit >= n_words)


_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def left_of(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, and the blanks that follow them."""
    at = [m.span() for m in _WORD.finditer(text)]
    parts, last = [], 0
    for s, e in spans:
        parts.append(text[last : at[s][0]])
        last = at[e][0] if e < len(at) else len(text)
    return "".join([*parts, text[last:]])


def remove_spans(found: DataFrame, text_col: str = "text", min_words: int = WINDOW) -> DataFrame:
    """Cuts hit spans of at least min_words words out of the texts of a find_windows() result, with the blank that follows."""

    @F.pandas_udf(T.StringType())
    def cut(text, hits):
        import pandas as pd

        out = []
        for t, h in zip(text, hits, strict=True):
            spans = [(s, e) for s, e in np.frombuffer(h or b"", dtype="<i4").reshape(-1, 2).tolist() if e - s >= min_words]
            out.append(left_of(t, spans) if t is not None and spans else t)
        return pd.Series(out, dtype=object)

    return found.withColumn(text_col, cut(F.col(f"`{text_col}`"), F.col("hits")))
