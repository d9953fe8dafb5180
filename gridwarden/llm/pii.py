"""Personal data: identifiers as written, and identifiers in disguise.

Four kinds are found as they stand. A chain of transducers then rewrites the disguises of a text, keeping for every character it writes
the span that it came from: look-alike letters and digits to ASCII, spelled digits in a row to digits, "at" and "dot" between name parts
to @ and a full stop. What is found in the rewritten text is mapped back; finds that rewriting made
are added under the kind's name with a prefix. Plain finds always stay.

Every search is linear in the text: an address is found from its @ outwards, a dotted number from its whole run.

Defined cases: null and empty texts have no spans; offsets are code points of the text as given, end exclusive; a disguised find
within a plain one of its kind is left out; equal texts give equal spans.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

KINDS = ["email", "ip", "card", "phone"]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[\x20-]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+` from left to right.

    Only one place before each @ can start one, the first character of the run of name characters that ends there.
    """
    out, free, at = [], 0, 0
    while m := _AT.search(text, at):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = at = m.end()
        else:
            at = m.start() + 1  # its domain may be the name of the next
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Fours of consecutive numbers in a dotted run, taken from its start; parts of at most 255."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, at + size))
            at += size + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def plain(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of identifiers as they stand, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(s, 1, e) for s, e in ips(text)]
        out += [(s, 2, e) for s, e in cards(text)]
        if "+" in text:
            out += [(s, 3, e) for s, e in phones(text)]
    return sorted(out)


#: Fixed list: letters of other scripts that look like an ASCII letter.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
}
#: Fixed list: digits in words.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


@lru_cache(4096)
def ascii_of(c: str) -> str:
    """The ASCII character that one of another script or width stands for; itself if none."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    wide = unicodedata.normalize("NFKC", c)
    if len(wide) == 1 and wide < "\x80" and wide != c:
        return wide
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


class Tape:
    """A text with the source span of every character."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def source(self, s: int, e: int) -> tuple[int, int]:
        return (s, e) if self.start is None else (self.start[s], self.end[e - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Puts in edits (start, end, what to write), which must be in order and apart."""
        if not edits:
            return
        start = self.start or range(len(self.text))
        end = self.end or range(1, len(self.text) + 1)
        parts, starts, ends, at = [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            parts += [self.text[at:s], new]
            starts += start[at:s]
            ends += end[at:s]
            if new:
                starts += [start[s]] * len(new)
                ends += [end[e - 1]] * len(new)
            at = e
        self.text, self.start, self.end = "".join(parts), starts, ends


#: How far from the @ of an address, plain or disguised, its dots may be.
REACH = 64
_ODD = re.compile("[^\x00-\x7f]")
_NUMBER = re.compile(r"(?<!\w)(?:%s)(?:[\x20,-]+(?:%s|[0-9]))+(?!\w)" % ("|".join(sorted(SPELLED, key=len, reverse=True)), "|".join(sorted(SPELLED, key=len, reverse=True))), re.I)
_SPELLED = re.compile(r"\w+")
_OPEN = r"(?:\x20?[\[({<]\x20?%s\x20?[\])}>]\x20?|\x20%s\x20)"
_DOT = _OPEN % (r"(?:dot|punkt|point|punto|\.)", "(?:dot|punkt)")
#: Four numbers with dots, plain or disguised, between them.
_FOUR = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_DISGUISE = re.compile(
    rf"(?P<at>{_OPEN % ('(?:at|arroba|@)', 'at')})(?=[A-Za-z0-9-]{{1,63}}(?:(?:{_DOT}|\.)[A-Za-z0-9-]{{1,63}}){{1,5}})" rf"|(?P<dot>{_DOT})(?=[A-Za-z0-9-])", re.I
)
_HINT = re.compile(r"[\[({<\x20](?:at|arroba|@|dot|punkt|point|punto|\.)[\])}>\x20]", re.I)


def normalise(text: str) -> Tape:
    """The transducers in turn."""
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(m.start(), m.end(), a) for m in _ODD.finditer(text) if (a := ascii_of(m.group())) != m.group()])
    numbers = []
    for m in _NUMBER.finditer(tape.text):
        tokens = _SPELLED.findall(m.group())
        if len(tokens) >= 4:
            numbers.append((m.start(), m.end(), "".join(SPELLED.get(t.lower(), t) for t in tokens)))
    tape.rewrite(numbers)
    if _HINT.search(tape.text):
        marks = list(_DISGUISE.finditer(tape.text))
        near = sorted([m.start() for m in marks if m["at"]] + [i for i, c in enumerate(tape.text) if c == "@"])
        fours = [x for m in _FOUR.finditer(tape.text) for x in m.span()]
        # a dot is one only near a place that an address may have its @ in, or between the numbers of one
        close = lambda p: (i := bisect_left(near, p - REACH)) < len(near) and near[i] <= p + REACH
        tape.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in marks if m["at"] or close(m.start()) or bisect_left(fours, m.start()) % 2])
    return tape


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end): plain kinds 0 to 3, and 4 to 7 for their disguised forms, in order."""
    own = plain(text)
    tape = normalise(text)
    if tape.start is None:
        return own
    covered: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    for s, k, e in own:
        covered[k].append((s, e))
    more = []
    for s, k, e in plain(tape.text):
        a, b = tape.source(s, e)
        if text[a:b] != tape.text[s:e]:
            more.append((a, k, b))
    fresh = []
    for k in range(len(KINDS)):
        at = 0
        for a, _, b in sorted(x for x in more if x[1] == k):
            while at < len(covered[k]) and covered[k][at][1] <= a:
                at += 1
            if at == len(covered[k]) or not (covered[k][at][0] <= a and b <= covered[k][at][1]):
                fresh.append((a, k + 4, b))
    return sorted([*own, *fresh])


NAMES = [*KINDS, *(f"masked_{k}" for k in KINDS)]


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each identifier replaced by its kind; of overlapping ones, the first and widest names the whole."""
    parts, at = [], 0
    joined: list[list[int]] = []
    for s, k, e in sorted(spans, key=lambda x: (x[0], -x[2])):
        if joined and s < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
        else:
            joined.append([s, k, e])
    for s, k, e in joined:
        parts += [text[at:s], f"<{KINDS[k % 4].upper()}>"]
        at = e
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, redacted: bool = False) -> DataFrame:
    """Adds spans, an array of (start, kind, end); with redacted also the text with each identifier replaced by its kind."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])

    def make():
        def kernel(texts: list[bytes]) -> list[pa.Array]:
            strings = [t.decode("utf-8", "replace") for t in texts]
            found = [find(t) for t in strings]
            made = [pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in f] for f in found], pa.list_(span))]
            if redacted:
                made.append(pa.array([redact(t, f) if f else t for t, f in zip(strings, found, strict=True)], pa.string()))
            return made

        return kernel

    integer = T.IntegerType()
    fields = [T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, integer) for n in ("start", "kind", "end")])))]
    if redacted:
        fields.append(T.StructField("redacted", T.StringType()))
    return append_columns(docs, text_col, make, fields, keep)
