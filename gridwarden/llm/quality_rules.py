"""Quality rules, with lines that many documents of a host share taken out.

Rules on a document alone: too few words, or too many words in repeated windows. Then across documents: lines are normalised and hashed, the distinct
documents of a host that have each are counted, lines above the limit are removed, and a document that loses most of its words is rejected.
The limit is a share of the host's documents, and never under a fixed number, so that it means the same at every size. Copies of a text are one
document there: a text is not boilerplate because it was copied.

Scale: lines are told apart within a task before they are shuffled, the key of the first shuffle has the text in it, and counts are
pre-aggregated, so neither a hot host nor a hot line meets in one task. Frequent lines are broadcast if few enough, and joined otherwise.

Defined cases: null and empty texts have no words and fail; a null host is a host of its own; lines without a letter or digit are no lines
here; repeated rows each get their row; without a host column all documents have one host.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORDS, append_columns, fresh, slices, texts_of, without, written

SYMBOLS = b"#*$%&|<>"
_NO_LETTERS = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])  # white space, and bytes that continue a character
SPAN = 8
MIN_WORDS, MAX_REPEATED = 20, 30
#: A line is frequent in over so many documents of its host, and over this share of them.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document with less than this share of its words left is rejected.
LEFT_SHARE = 0.3
#: Frequent lines that may be broadcast (16 bytes each).
BROADCAST_LINES = 1_000_000

_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, SPAN + 1)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of SPAN words that the text has twice or more."""
    n = len(words) - SPAN + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        total = h[:n] * _MIX[0]
        for k in range(1, SPAN):
            total += h[k : n + k] * _MIX[k]
    order = np.sort(total)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(total, twice)).tolist()
    windows = Counter(tuple(words[i : i + SPAN]) for i in at)  # equal hashes are not taken for equal words
    hit = np.zeros(len(words), dtype=bool)
    for i in at:
        if windows[tuple(words[i : i + SPAN])] > 1:
            hit[i : i + SPAN] = True
    return int(hit.sum())


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    lines = text.split(b"\n")
    duplicates = 0
    if len(set(lines)) < len(lines):
        counts = Counter(lines)
        duplicates = sum(c - 1 for line, c in counts.items() if c > 1 and line.split())
    return len(words), len(text.translate(None, _NO_LETTERS)), len(text) - len(text.translate(None, SYMBOLS)), duplicates, repeated_words(words)


def line_keys(text: bytes, host: bytes) -> list[tuple[int, int]]:
    """(hash of host and normalised line, words) of each line with a letter or digit, in order."""
    out, digest, mark = [], xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(host, 1)
    for line in text.split(b"\n"):
        words = line.translate(WORDS).split()
        if words:
            out.append((digest(b" ".join(words), mark), len(line.split())))
    return out


def without_lines(text: bytes, host: bytes, gone: np.ndarray) -> bytes:
    """The text without the lines whose hash is in gone, which is in order."""
    lines, mark = text.split(b"\n"), xxhash.xxh64_intdigest(host, 1)
    words = [line.translate(WORDS).split() for line in lines]
    hashes = _signed([xxhash.xxh64_intdigest(b" ".join(w), mark) for w in words])
    cut = np.isin(hashes, gone)
    return b"\n".join(line for line, w, c in zip(lines, words, cut.tolist(), strict=True) if not (w and c))


def _signed(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str | None = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """Rows (line, n_docs): hashes of host and line above the limit."""
    host = F.col(f"`{host_col}`").cast("string") if host_col else F.lit("")
    rows = docs.select(F.col(f"`{text_col}`").alias("body"), host.alias("host"))
    # copies of a text are one document on both sides of the limit
    texts = rows.select("host", F.xxhash64(F.coalesce("body", F.lit(""))).alias("doc")).distinct()
    per_host = texts.groupBy("host").agg(F.count("*").alias("n_host"))

    def run(batches):
        for piece in slices(batches, 0):
            texts, hosts = texts_of(piece.column(0)), piece.column(1).to_pylist()
            keys, docs_of, host_of = [], [], []
            for t, h in zip(texts, hosts, strict=True):
                own = {k for k, _ in line_keys(t, b"\0" if h is None else h.encode())}
                keys += own
                docs_of += [xxhash.xxh64_intdigest(t)] * len(own)
                host_of += [h] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(_signed(docs_of)), pa.array(host_of, pa.string())], names=["line", "doc", "host"])

    seen = rows.mapInArrow(run, "line long, doc long, host string")
    counted = seen.distinct().groupBy("line").agg(F.count("*").alias("n_docs"), F.first("host").alias("host"))
    over = counted.where(F.col("n_docs") > line_docs)
    joined = over.join(per_host, over["host"].eqNullSafe(per_host["host"]))
    return joined.where(F.col("n_docs") > line_share * F.col("n_host")).select("line", "n_docs")


def apply_rules(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str | None = "source",
    keep: list[str] | None = None,
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    left_share: float = LEFT_SHARE,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed, base_failed and kept to every row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed"]
    keep = without(docs.columns if keep is None else keep, (*names, "base_failed", "kept"))
    frequent = written(frequent_lines(docs, text_col, host_col, line_docs, line_share), "lines")
    few = frequent.count() <= broadcast_lines
    lines = np.sort(frequent.select("line").toArrow()["line"].to_numpy()) if few else None
    sent = docs.sparkSession.sparkContext.broadcast(lines)
    packed, row = fresh("host_and_text", docs.columns), fresh("row", docs.columns)
    host = F.col(f"`{host_col}`").cast("string") if host_col else F.lit("")
    # the host goes before the text, in one column for the kernel; its length first
    source = docs.withColumn(packed, F.concat(F.coalesce(F.octet_length(host), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(host, F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))

    def make():
        known = sent.value

        def kernel(texts: list[bytes]) -> list[pa.Array]:
            rows, removed, left = [], [], []
            for packed in texts:
                size, _, rest = packed.partition(b":")
                n = int(size)
                own, t = (b"\0", rest) if n < 0 else (rest[:n], rest[n:])
                rows.append(measure(t))
                keys = line_keys(t, own) if known is None or len(known) else []
                if known is None:
                    removed.append(0)
                    left.append([{"line": int(k), "words": w} for k, w in zip(_signed([k for k, _ in keys]).tolist(), (w for _, w in keys), strict=True)])
                    continue
                hashes = _signed([k for k, _ in keys])
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                gone = known[at] == hashes if len(keys) else []
                removed.append(sum(w for (_, w), g in zip(keys, gone, strict=True) if g))
                left.append(None)
            made = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            return [*made, pa.array(removed, pa.int64()), pa.array(left, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))]

        return kernel

    kind = T.ArrayType(T.StructType([T.StructField("line", T.LongType()), T.StructField("words", T.LongType())]))
    made = append_columns(source, packed, make, [*(T.StructField(f"m_{n}", T.LongType()) for n in names), T.StructField("m_lines", kind)], keep)
    inner = [f"k{i}" for i in range(len(keep))]
    made = made.toDF(*inner, *(f"m_{n}" for n in names), "m_lines")
    if not few:
        # rows are numbered in a written table, so that a task that runs again numbers them alike
        made = written(made.withColumn(row, F.monotonically_increasing_id()), "measured")
        gone = made.select(row, F.explode("m_lines").alias("x")).select(row, "x.*").join(frequent, "line").groupBy(row).agg(F.sum("words").alias("gone"))
        made = made.join(gone, row, "left").withColumn("m_n_removed", F.coalesce("gone", F.lit(0)))
    words, again = F.col("m_n_words"), F.col("m_n_repeat_words")
    failed = (words < MIN_WORDS) | (100 * again > MAX_REPEATED * words)
    depleted = (words - F.col("m_n_removed")) < F.lit(left_share) * words
    return made.select(*(F.col(i).alias(c) for i, c in zip(inner, keep, strict=True)), *(F.col(f"m_{n}").alias(n) for n in names), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))


def remove_lines(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str | None = "source",
    line_docs: int = LINE_DOCS,
    line_share: float = LINE_SHARE,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """The documents, all columns, with the frequent lines of their host cut out of the text. A null text stays null."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    host = F.col(names[docs.columns.index(host_col)]).cast("string") if host_col else F.lit("")
    frequent = written(frequent_lines(docs, text_col, host_col, line_docs, line_share), "lines")
    rows = docs.toDF(*names).withColumn("host", host)
    few = frequent.count() <= broadcast_lines
    if few:
        known = docs.sparkSession.sparkContext.broadcast(np.sort(frequent.select("line").toArrow()["line"].to_numpy()))
        rows = rows.withColumn("gone", F.lit(None).cast("array<long>"))
    else:
        known = None
        rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")

        def hashed(batches):
            for piece in slices(batches, 2):
                at, lines = [], []
                for r, h, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), texts_of(piece.column(2)), strict=True):
                    own = {k for k, _ in line_keys(t, b"\0" if h is None else h.encode())}
                    at += [r] * len(own)
                    lines += own
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(_signed(lines))], names=["row", "line"])

        met = rows.select("row", "host", text).mapInArrow(hashed, "row long, line long").join(frequent.select("line"), "line")
        rows = rows.join(met.groupBy("row").agg(F.collect_list("line").alias("gone")), "row", "left").drop("row")

    def run(batches):
        k = names.index(text)
        for piece in slices(batches, k):
            host, gone = piece.column(len(names)).to_pylist(), piece.column(len(names) + 1).to_pylist()
            out = []
            for t, h, g in zip(piece.column(k).to_pylist(), host, gone, strict=True):
                lines = known.value if known is not None else np.sort(np.array(g or [], dtype=np.int64))
                out.append(t if t is None or not len(lines) else without_lines(t.encode(), b"\0" if h is None else h.encode(), lines).decode())
            yield piece.set_column(k, piece.schema.field(k), pa.array(out, piece.schema.field(k).type)).select(names)

    return rows.select(*names, "host", "gone").mapInArrow(run, docs.toDF(*names).schema).toDF(*docs.columns)
