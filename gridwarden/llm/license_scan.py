"""Licence scan: exact phrases, and a fuzzy search for short notices.

A notice that occurs with at most k errors, cut into k+1 pieces, has one piece untouched (pigeonhole). All pieces of all notices are
sought in one pass; around each find the regex library's bounded-error matching verifies the whole notice and gives its span. Texts
are searched as lower-cased words with one space between.

Defined cases: null and empty texts have no words, labels or spans and score 0; overlapping places of a phrase all count; of overlapping
fuzzy finds of one notice the one with the fewest errors stays, of equals the first, then the shortest; a find beside it stays too. The time of a long
text is in proportion to its seeds. Repeated rows each get their row.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heappop, heappush
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import alnum_words, append_columns

#: Fixed phrases and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Short notices, their labels, and the errors (letters put in, left out or changed) each may have.
NOTICES = [
    ("released under the mit license", "mit", 3),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 6),
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("gnu general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license version 2 0", "mpl-2.0", 3),
    ("licensed under a creative commons attribution", "cc-by", 4),
    ("all rights reserved", "reserved", 1),
]


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice in errors + 1 parts of about one length, with their offsets."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Searcher:
    def __init__(self, phrases=None, notices=None):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.notices = NOTICES if notices is None else notices
        self.verify = [regex.compile(f"(?b)(?:{regex.escape(n)}){{e<={k}}}") for n, _, k in self.notices]
        self.bounded = [[regex.compile(f"(?:{regex.escape(n)}){{e<={e}}}") for e in range(k + 1)] for n, _, k in self.notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _, k) in enumerate(self.notices):
            for at, piece in pieces(n, k):
                seeds.setdefault(piece, []).append((i, at))
        self.find = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.find.add_word(piece, (len(piece), owners))
        self.find.make_automaton()

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """(word, label) of every place of a phrase in ' a b c '."""
        out = []
        for phrase, label in self.phrases:
            at, word, counted = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                out.append((word, label))
                at = joined.find(phrase, at + 1)
        return out

    def best(self, i: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        """Of the places of notice i in text[low:high] the (errors, start, end) that comes first."""
        notice, _, k = self.notices[i]
        if high - low < len(notice) - k or not (m := self.verify[i].search(text, low, high)):
            return None
        errors = sum(m.fuzzy_counts)
        if not errors:
            return 0, m.start(), m.end()
        exact = self.bounded[i][errors]  # no place has fewer, so that all that it finds have so many
        start = next(s for s in range(low, m.start() + 1) if exact.match(text, s, high))
        end = next(e for e in range(max(start, start + len(notice) - errors), high + 1) if exact.fullmatch(text, start, e))
        return errors, start, end

    def fuzzy(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, score) in characters of the joined words.

        A seed allows its notice in a window of the notice's length and the errors either way; each is verified by itself, in time that the window bounds. The
        finds of all windows are taken in order, fewest errors first, and a window in which an earlier one lies is searched again beside it.
        """
        places: dict[int, set[int]] = {}
        for last, (size, owners) in self.find.iter(text):
            for i, offset in owners:
                places.setdefault(i, set()).add(last + 1 - size - offset)
        out = []
        for i, starts in places.items():
            notice, label, k = self.notices[i]
            found: list[tuple] = []

            def look(low: int, high: int) -> None:
                if place := self.best(i, text, low, high):  # noqa: B023
                    heappush(found, (*place, low, high))  # noqa: B023

            for at in starts:
                look(max(0, at - k), min(len(text), at + len(notice) + k))
            taken: list[tuple[int, int]] = []
            while found:
                errors, start, end, low, high = heappop(found)
                at = bisect_left(taken, (start, 0))
                before, after = taken[at - 1] if at else None, taken[at] if at < len(taken) else None
                if (start, end) == after:
                    continue
                if before and before[1] > start:
                    look(max(low, before[1]), high)
                    look(low, min(high, before[0]))
                elif after and after[0] < end:
                    look(low, min(high, after[0]))
                    look(max(low, after[1]), high)
                else:
                    taken.insert(at, (start, end))
                    out.append((start, end, label, 1.0 - errors / len(notice)))
                    look(low, start)
                    look(end, high)
        return sorted(out)


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, phrases=None, notices=None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score, and notices: word spans with label and score."""

    def make():
        search = Searcher(phrases, notices)

        def one(t: bytes) -> dict:
            words = alnum_words(t)
            joined = b" ".join(words)
            base = search.exact(b" %b " % joined)
            text = joined.decode("utf-8", "replace")
            near = search.fuzzy(text)
            spans = []
            if near:
                starts = list(accumulate((len(w.decode("utf-8", "replace")) + 1 for w in words), initial=0))
                spans = [{"first": bisect_right(starts, s) - 1, "last": bisect_right(starts, max(s, e - 1)) - 1, "label": label, "score": p} for s, e, label, p in near]
            own = {label for _, label in base}
            places = [w for w, _ in base]
            return {
                "n_words": len(words), "n_base": len(base), "first_word": min(places, default=None), "last_word": max(places, default=None),
                "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x[2] for x in near})),
                "score": 1.0 if base else max((x[3] for x in near), default=0.0), "notices": spans,
            }

        span = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("label", pa.string()), ("score", pa.float64())])
        kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "notices": pa.list_(span)}

        def kernel(texts: list[bytes]) -> list[pa.Array]:
            rows = [one(t) for t in texts]
            return [pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]

        return kernel

    long, string = T.LongType(), T.StringType()
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("label", string), T.StructField("score", T.DoubleType())])
    kinds = {"n_words": long, "n_base": long, "first_word": long, "last_word": long, "base_labels": string, "labels": string, "score": T.DoubleType(), "notices": T.ArrayType(span)}
    return append_columns(docs, text_col, make, [T.StructField(k, v) for k, v in kinds.items()], keep)
