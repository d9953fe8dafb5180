"""SentencePiece encoding and decoding through a table of distinct marked words.

The text is cut before every run of whitespace markers and around line feeds. In a vocabulary with no piece
that goes on past such a cut, no merge crosses it, so each distinct chunk needs segmenting once; the ids of a text are
those of its chunks joined by position. The table lives in the task: a table of the whole corpus would have to be joined
back by a shuffle of every token, several times the size of the input. It is bounded, and emptied when full.

Defined cases: null or empty text gives the begin and end ids only; equal texts give equal ids; any vocabulary whose
pieces do cross a cut is refused by separable(), and then whole texts go to the library. Repeated rows each get their ids.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns

MARK = "▁"
#: Distinct chunks that a task's table holds.
TABLE_CHUNKS = 100_000
#: Longer chunks are segmented when met and not kept.
KEPT_CHARS = 64
_CHUNK = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|\n[^ {MARK}\n]*|[^ {MARK}\n]+")


#: Longer texts are segmented in pieces of about so many characters.
PIECE_CHARS = 1 << 19
_BORDER = re.compile(r"(?<! ) |\n")


def pieces(marked: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """A text whose markers are blanks, in pieces that start where a chunk does."""
    at = 0
    while at < len(marked):
        m = _BORDER.search(marked, at + size)
        end = m.start() if m else len(marked)
        yield marked[at:end]
        at = end


def load(proto: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def separable(sp) -> bool:
    """No piece crosses a cut, and the library puts one marker before a text and keeps all other whitespace."""
    for i in range(sp.vocab_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        if "\n" in piece or MARK in piece.lstrip(MARK):
            return False
    probe = f"  a  b \n c{MARK}d "
    joined = "".join(p for p in sp.encode(probe, out_type=str)).replace("<0x0A>", "\n")
    return joined == (" " + probe).replace(" ", MARK)


class Encoder:
    """Text to little-endian 32-bit ids; the same as the library's for every text."""

    def __init__(self, proto: bytes, table_chunks: int = TABLE_CHUNKS):
        self.sp, self.table, self.most = load(proto), {}, table_chunks
        self.whole = not separable(self.sp)
        self.mark = array("I", self.sp.encode("\n"))[:1].tobytes()  # ids are kept as the machine's 32-bit numbers, little-endian ones
        # what the library puts before a line feed must be the marker alone, which a chunk that starts with one drops again
        self.whole |= self.sp.encode("\n", out_type=str)[:1] != [MARK]

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """A leading marker is the one that the library adds itself, though not to an empty text; before a line feed it must go again."""
        ids = self.sp.encode([c if c[0] == "\n" else c[1:] for c in chunks])
        packed = [array("I", x).tobytes() for x in ids]
        return [p[4:] if c[0] == "\n" else p or self.mark for c, p in zip(chunks, packed, strict=True)]

    def pack(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [array("I", x).tobytes() for x in self.sp.encode(texts)]
        if any(len(t) > PIECE_CHARS for t in texts):
            # long texts in pieces between chunks, so that memory does not follow the length of a text
            return [b"".join(self._pack(p) for p in pieces(f" {t}".replace(MARK, " "))) if t else b"" for t in texts]
        return self._pack_all([f" {t}".replace(MARK, " ") if t else "" for t in texts])

    def _pack(self, marked: str) -> bytes:
        return self._pack_all([marked])[0]

    def _pack_all(self, marked: list[str]) -> list[bytes]:
        cut = [_CHUNK.findall(t) for t in marked]
        # the chunks of all these texts that the table lacks are segmented in one call
        new = list(set().union(*cut).difference(self.table))
        if len(self.table) + len(new) > self.most:
            self.table = {}
            new = list(set().union(*cut))
        self.table.update(zip(new, self._segment(new), strict=True))
        get = self.table.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in cut]
        for c in new:
            if len(c) > KEPT_CHARS:
                del self.table[c]
        return out


def encode_documents(
    docs: DataFrame,
    model_path: str,
    text_col: str = "text",
    keep: list[str] | None = None,
    begin: bool = True,
    end: bool = True,
    table_chunks: int = TABLE_CHUNKS,
    made: tuple[str, ...] = ("ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"),
) -> DataFrame:
    """Adds what `made` names to every row: ids (array of int), n_tokens, ids_sha256, decoded, decoded_sha256.

    The vocabulary file is read by the driver and sent to the tasks: half a megabyte whatever the input.
    """
    proto = docs.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def make():
        enc = Encoder(proto.value, table_chunks)
        head = array("I", [enc.sp.bos_id()] * begin).tobytes()
        tail = array("I", [enc.sp.eos_id()] * end).tobytes()
        sha, back = hashlib.sha256, enc.sp.decode

        def kernel(texts: list[bytes]) -> list[pa.Array]:
            packed = [head + p + tail for p in enc.pack([t.decode("utf-8", "replace") for t in texts])]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            decoded = [back(memoryview(p).cast("I").tolist()) for p in packed] if {"decoded", "decoded_sha256"} & set(made) else []
            columns = {
                "ids": lambda: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))),
                "n_tokens": lambda: pa.array(np.diff(ends), pa.int64()),
                "ids_sha256": lambda: pa.array([sha(p).hexdigest() for p in packed]),
                "decoded": lambda: pa.array(decoded, pa.string()),
                "decoded_sha256": lambda: pa.array([sha(d.encode()).hexdigest() for d in decoded]),
            }
            return [columns[c]() for c in made]

        return kernel

    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}
    return append_columns(docs, text_col, make, [T.StructField(c, kinds.get(c, T.StringType())) for c in made], keep)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text that ids stand for; null ids give an empty text."""
    proto = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    @F.pandas_udf(T.StringType())
    def back(ids):
        import pandas as pd

        sp = load(proto.value)
        return pd.Series(["" if x is None else sp.decode([int(i) for i in x]) for x in ids])

    return df.withColumn(out_col, back(F.col(ids_col)))
