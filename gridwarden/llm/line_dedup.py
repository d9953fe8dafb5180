"""Lines that many documents share, removed everywhere but in one document.

A first pass puts the keys of long lines into two Bloom filters, one of keys seen once and one of keys seen in a second document. A second pass tests lines
against the filter of those seen twice: only what it suspects is shuffled, where documents are counted exactly, by 128-bit hashes, and the document that
keeps the line is chosen. A last pass rewrites the texts.

Scale: the filters are cut into segments by hash. A task sends what it has seen to the segments, these put it together in streams of bounded memory, so no task
holds a whole filter while it is made. Filters grow with the input, as a text has one long line at most for so many bytes, up to MAX_SEGMENTS; the filter of lines
seen twice, MAX_SEGMENTS * SEGMENT_BITS / 8 = 128 MB at most, is broadcast. Beyond some 2.6e8 possible lines it suspects more and more of those seen once, which costs
shuffle, but never a result: what it suspects is counted exactly. A hot line is one row a task after partial aggregation. Shared lines are broadcast up to
BROADCAST_LINES, and joined by row beyond.

Defined cases: null and empty texts are one empty line; a document is a row, so repeated rows count each, and rows that share the largest id all keep their lines; null ids are the smallest,
and where a line has no other they all keep it; a line repeated within a document counts once and stays or goes as a whole; an empty table gives no rows; a very long text is split in one go, at
some two times its size. Columns other than id and text are passed on unread, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, forget, placed, slices, small_enough, texts_of, without, written

#: A key has so many code points at least, and is removed if so many documents have it.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: Bits of a segment of a filter, and the most segments.
SEGMENT_BITS, MAX_SEGMENTS = 1 << 20, 1024
#: Bits of a filter for every line that a text of so many bytes may have, and places of a key in it.
BITS_A_LINE, PLACES = 4, 4
#: Keys that a task gathers before it sends them to the segments.
CHUNK_KEYS = 1 << 20
#: Shared lines that may be broadcast (16 bytes and an id each).
BROADCAST_LINES = 1_000_000

_INNER = bytes(range(0x80, 0xC0))  # bytes that continue a character


def line_digests(text: bytes, least: int = LEAST_CHARS) -> tuple[list[int], np.ndarray]:
    """Numbers of the lines whose key (stripped of white space, A-Z lower-cased) has so many code points, and the two halves of each key's hash."""
    at, out, digest = [], [], xxhash.xxh3_128_digest
    for i, line in enumerate(text.translate(LOWER).split(b"\n")):
        if len(line) >= least:
            key = line.strip()
            if len(key) >= 4 * least or len(key) - (0 if key.isascii() else len(key) - len(key.translate(None, _INNER))) >= least:
                at.append(i)
                out.append(digest(key))
    return at, np.frombuffer(b"".join(out), dtype="<u8").reshape(-1, 2)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of hashes, and how often each is there."""
    h = h[np.lexsort((h[:, 1], h[:, 0]))]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]).any(axis=1)
    at = np.flatnonzero(first)
    return h[at], np.diff(np.append(at, len(h)))


def _places(low: np.ndarray) -> np.ndarray:
    """Places of keys within their segment."""
    mask = np.uint64(SEGMENT_BITS - 1)
    start, step = low & mask, (low >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((start[:, None] + step[:, None] * np.arange(PLACES, dtype=np.uint64)) & mask).astype(np.int64)


def _own_keys(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of each text, one after the other, and the number of each key's text."""
    made = [_distinct(h)[0] if len(h) else h for h in (line_digests(t, least)[1] for t in texts)]
    return np.concatenate([np.empty((0, 2), dtype="<u8"), *made]), np.repeat(np.arange(len(texts)), [len(h) for h in made])


def segments_for(n_bytes: int, least: int = LEAST_CHARS) -> int:
    """Segments, a power of two, for texts of so many bytes."""
    lines = n_bytes // (least + 1) + 1
    n = 1
    while n < MAX_SEGMENTS and n * SEGMENT_BITS < lines * BITS_A_LINE:
        n *= 2
    return n


def seen_twice(texts: DataFrame, n_segments: int, least: int = LEAST_CHARS) -> DataFrame:
    """Rows (segment, bits): the Bloom filter of keys that may be in two documents or more; texts has one column. Segments without any are left out."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            keys, times = _distinct(np.concatenate(held))
            segment = (keys[:, 0] & np.uint64(n_segments - 1)).astype(np.int64)
            order = np.argsort(segment, kind="stable")
            keys, times, segment = keys[order], times[order], segment[order]
            cuts = np.flatnonzero(np.diff(segment, prepend=-1))
            parts = [(int(segment[a]), keys[a:b, 1], times[a:b]) for a, b in zip(cuts, [*cuts[1:], len(segment)], strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in parts], pa.int32()), *(pa.array([low[(t > 1) == again].tobytes() for _, low, t in parts], pa.binary()) for again in (False, True))],
                names=["segment", "once", "twice"],
            )

        for piece in slices(batches, 0):
            keys, _ = _own_keys(texts_of(piece.column(0)), least)
            if len(keys):
                held.append(keys)
                n += len(keys)
            if n >= CHUNK_KEYS:
                yield rows()
                held, n = [], 0
        if held:
            yield rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = once = twice = None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])
        for batch in batches:
            for segment, *sent in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if segment != now:
                    if now is not None and twice.any():
                        yield done()
                    now, once, twice = segment, np.zeros(SEGMENT_BITS, dtype=bool), np.zeros(SEGMENT_BITS, dtype=bool)
                for again, keys in enumerate(sent):
                    low = np.frombuffer(keys, dtype="<u8")
                    for a in range(0, len(low), 1 << 16):
                        at = _places(low[a : a + (1 << 16)])
                        twice[at if again else at[once[at].all(axis=1)]] = True
                        once[at] = True
        if now is not None and twice.any():
            yield done()

    sent = texts.mapInArrow(send, "segment int, once binary, twice binary")
    return sent.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")


def _suspected(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which keys the filter holds; bits: a row for each segment."""
    segment = (keys[:, 0] & np.uint64(len(bits) - 1)).astype(np.int64)
    at = _places(keys[:, 1])
    return ((bits[segment[:, None], at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


def _halves(keys: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64)) for i in (0, 1)]


class _Shared:
    """Shared lines, looked up by hash."""

    def __init__(self, table: pa.Table):
        keys = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("high", "low")], axis=1).reshape(-1, 2)
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        self.keys = keys[order]
        self.kept = table.column("kept").combine_chunks().take(pa.array(order))
        self.ties = int(np.unique(self.keys[:, 0], return_counts=True)[1].max(initial=0))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's row; -1 without."""
        out, start = np.full(len(keys), -1), np.searchsorted(self.keys[:, 0], keys[:, 0])
        for k in range(self.ties):  # more than one only if half a hash is shared
            at = np.minimum(start + k, len(self.keys) - 1)
            out = np.where((self.keys[at] == keys).all(axis=1), at, out)
        return out


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    made: tuple[str, ...] = ("n_lines", "n_dropped", "kept_sha256", "left"),
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Adds to every document n_lines, n_dropped, left (the text without the lines that go) and kept_sha256 of it; made: those wanted.

    Lines go whose key has at least least_chars code points and is found in at least least_docs (two or more) documents, but not from the document with the largest id that has it.
    """
    if least_docs < 2 or least_chars < 1:
        raise ValueError("lines of one document, and empty ones, are not shared")
    kinds = {"n_lines": (pa.int64(), T.LongType()), "n_dropped": (pa.int64(), T.LongType()), "kept_sha256": (pa.string(), T.StringType()), "left": (pa.string(), T.StringType())}
    kept_columns = without(docs.columns if keep is None else keep, made)
    spark = docs.sparkSession
    asked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept_columns)))
    n_bytes = asked.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n_segments = segments_for(n_bytes, least_chars)
    bits = np.zeros((n_segments, SEGMENT_BITS // 8), dtype=np.uint8)
    for row in seen_twice(asked.select("body"), n_segments, least_chars).toLocalIterator():
        bits[row.segment] = np.frombuffer(row.bits, dtype=np.uint8)
    sent = spark.sparkContext.broadcast(bits)

    def suspects(rows: DataFrame) -> DataFrame:
        """Rows (high, low, and the columns of rows but the last, which is the text) for each key of each row that may be in two documents."""
        names = rows.columns[:-1]
        kind = T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), *(rows.schema[n] for n in names)])

        def run(batches):
            k = len(names)
            for piece in slices(batches, k):
                keys, owner = _own_keys(texts_of(piece.column(k)), least_chars)
                there = _suspected(keys, sent.value)
                at = pa.array(owner[there])
                yield pa.RecordBatch.from_arrays([*_halves(keys[there]), *(piece.column(i).take(at) for i in range(k))], names=kind.names)

        return rows.mapInArrow(run, kind)

    counted = suspects(asked.select("id", "body")).groupBy("high", "low").agg(F.count("*").alias("n"), F.max("id").alias("kept"))
    shared = written(counted.where(F.col("n") >= least_docs).select("high", "low", "kept"), "shared")
    few = small_enough(shared, broadcast_lines)
    if few:
        known = spark.sparkContext.broadcast(_Shared(shared.toArrow()))
        rows = asked.withColumn("gone", F.lit(None).cast("array<struct<high: bigint, low: bigint>>"))
    else:
        known = None
        base = placed(asked, "rows")  # c0 is the id and c1 the text there
        met = suspects(base.select(F.col("c0").alias("id"), "file", "place", F.col("c1").alias("body"))).join(shared, ["high", "low"]).where(~F.col("id").eqNullSafe(F.col("kept")))
        lists = met.groupBy("file", "place").agg(F.collect_list(F.struct("high", "low")).alias("gone"))
        back = base.join(lists, ["file", "place"], "left")
        rows = back.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(asked.columns)), "gone")

    out_kind = T.StructType([rows.schema[f"c{i}"] for i in range(len(kept_columns))] + [T.StructField(f"o{i}", kinds[m][1]) for i, m in enumerate(made)])

    def rewrite(text: bytes, own, gone) -> tuple:
        at, keys = line_digests(text, least_chars)
        cut: list[int] = []
        if known is not None and len(keys) and len(known.value.keys):
            row = known.value.find(keys)
            cut = [i for i, r in zip(at, row.tolist(), strict=True) if r >= 0 and known.value.kept[r].as_py() != own]
        elif gone:
            away = {(x["high"], x["low"]) for x in gone}
            cut = [i for i, *key in zip(at, *(np.ascontiguousarray(keys[:, j]).view(np.int64).tolist() for j in (0, 1)), strict=True) if tuple(key) in away]
        n = text.count(b"\n") + 1
        if cut:
            lines = text.split(b"\n")
            for i in cut:
                lines[i] = None
            text = b"\n".join(x for x in lines if x is not None)
        return n, len(cut), hashlib.sha256(text).hexdigest(), text

    order = ("n_lines", "n_dropped", "kept_sha256", "left")

    def run(batches):
        for piece in slices(batches, 1):
            last = piece.num_columns - 1
            done = [rewrite(*x) for x in zip(texts_of(piece.column(1)), piece.column(0).to_pylist(), piece.column(last).to_pylist(), strict=True)]
            results = [pa.array([r[order.index(m)] for r in done] if m != "left" else [r[3].decode() for r in done], kinds[m][0]) for m in made]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(2, last)), *results], names=out_kind.names)

    out = rows.mapInArrow(run, out_kind).toDF(*kept_columns, *made)
    if few:
        forget(shared)
    return out


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the query."""
    return f"""
WITH lines AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
each_line AS (SELECT doc_id, generate_subscripts(parts, 1) AS nr, unnest(parts) AS line FROM lines),
keyed AS (
  SELECT doc_id, nr, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM each_line
),
shared AS (SELECT k, max(doc_id) AS kept FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
told AS (SELECT doc_id, nr, line, kept IS NOT NULL AND kept <> doc_id AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id
"""
