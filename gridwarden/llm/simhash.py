"""Near-duplicate groups by SimHash and multi-index hashing.

A fingerprint's segments are indexed apart, each is looked up with the Hamming ball of radius one around it, and every match is verified on the whole.
By distance: two halves of 64 bits, so that what differs in at most three bits is found for certain. By similarity: twenty segments of 28 bits;
fingerprints that differ in at most 39 bits of the 560 are found for certain, others mostly (texts of similarity 0.8 differ in 80 or so), and the shingles
themselves decide.

Scale: texts with one fingerprint, or by similarity one set of shingles, are one node, so a group of copies is one row before anything is joined. Matches are
equi-joins on 33-bit keys, which adaptive execution splits where a key is hot; pairs are verified inside
the join and only links leave it. Components are found by alternating stars over tables in the shared folder.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; a group's name is its smallest id,
null only if it has no other; repeated rows are separate rows of one group. A very long text is hashed in pieces.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, append_columns, forget, placed, slices, small_enough, texts_of, written

SHINGLE_WORDS, SIMILARITY = 5, 0.8
MAX_BITS = 3
SEED = 42


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; 0 without words."""
    return int(np.packbits(_majority(shingle_hashes(text, width)), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, out_col: str = "fp", width: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the fingerprint of each text as a signed 64-bit number."""

    def make():
        def kernel(texts: list[bytes]) -> list[pa.Array]:
            return [pa.array(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))]

        return kernel

    return append_columns(docs, text_col, make, [T.StructField(out_col, T.LongType())], keep)


def _matches(nodes: DataFrame, segments, bits: int, near, group: str | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the fp of nodes that have a segment at most one bit apart and are near; some come several times.

    Every segment is in a table under its number and value, and looked up with the Hamming ball of radius one around it. Of a pair one bit apart only the
    side that lacks the bit finds the other. Nodes of one group, where it is not 0, are not paired, nor a node with one of a group that is in its `beside`.
    Neither side is broadcast: Spark sizes what an explode makes as its one row before, so that tens of millions of rows seem small.
    """
    if not 1 <= bits <= 32:
        raise ValueError("a segment has up to 32 bits")
    own = ["fp"] if group is None else ["fp", group, "beside"]
    cut = nodes.select(*own, F.posexplode(segments).alias("number", "segment"))
    key = (F.col("number").cast("long") * F.lit(1 << 32)) + F.col("segment").cast("long")
    table = cut.select(key.alias("key"), F.col("fp").alias("b"), *own[1:])
    one = F.array(*(F.lit(0 if i < 0 else 1 << i).cast("long") for i in range(-1, bits)))
    ball = cut.select(key.alias("base"), F.col("fp").alias("a"), *own[1:], F.explode(one).alias("bit"))
    ball = ball.where(F.col("base").bitwiseAND(F.col("bit")) == 0).select((F.col("base") + F.col("bit")).alias("key"), "a", *own[1:])
    met = (F.col("p.key") == F.col("t.key")) & (F.col("p.a") != F.col("t.b")) & near(F.col("p.a"), F.col("t.b"))
    if group:
        met &= (F.col(f"p.{group}") == 0) | (F.col(f"p.{group}") != F.col(f"t.{group}"))
        seen = lambda x, y: F.coalesce(F.array_contains(f"{x}.beside", F.col(f"{y}.{group}")), F.lit(False))
        met &= ~seen("p", "t") & ~seen("t", "p")
    found = ball.alias("p").join(table.alias("t").hint("merge"), met)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _apart(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most max_bits (up to 3) apart; nodes has distinct ones in fp. Some come several times."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves and balls of radius one find up to three differing bits")
    halves = F.array(F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    return _matches(nodes, halves, 32, lambda a, b: _apart(a, b) <= max_bits)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Rows (node, root) for every node of edges (a, b); root is the smallest node that it reaches.

    Alternating large and small stars: each round hangs the neighbours of a node below its smallest one, so that rounds
    grow with the logarithm of the longest chain. A star's centre may have any number of neighbours: the minimum is taken by a
    partial aggregation and written, and the join back has plain exchanges on both sides, which can be split.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(limit):
        for large in (True, False):
            both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else now
            low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
            hung = both.join(low, "u")
            if large:
                pairs = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                pairs = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
            later = written(pairs.where("u <> v").distinct(), "edges")
            forget(low)
            forget(now)
            now = later
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    out._gridwarden_path = now._gridwarden_path
    return out


def group_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per document: its id, fp and component_id, the smallest id that links reach."""
    prints = written(fingerprints(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("body")), "body", ["id"], width=width), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    rooted, name = _named(nodes, max_bits)
    label = written(rooted.join(name, "root").select("fp", "component_id"), "labels")
    for done in (nodes, rooted, name):
        forget(done)
    return prints.join(label, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _named(nodes: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Of nodes (fp, least): rows (fp, least, root), and rows (root, component_id), the smallest least of each component."""
    linked = written(links(nodes.select("fp"), max_bits), "links")
    member = components(linked)
    rooted = nodes.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    name = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    forget(linked)
    forget(member)
    return rooted, name


#: The wide fingerprint: segments, and bits of each. Pairs of which all segments differ in two bits or more are not found.
SEGMENTS, SEGMENT_BITS = 20, 28
#: The same bits cut anew, to find the middles of large groups.
MARKS, MARK_BITS = 35, 16
#: Members of a group from which texts beside it are compared with all of it in blocks, and texts on each side of a block.
LARGE_GROUP, BLOCK = 200, 128
#: Nodes that stand for a mark by chance, and those that a node is compared with.
MIDDLES, NEAREST = 7, 8
#: Nodes with one mark that are looked at together; more are dealt out in parts of so many. The rows are the same.
FEW_NODES = 4096
#: Bits of 64 in which candidates may differ, and bits of the wide fingerprint (560): what is near for certain, and two bands to look at, nearer ones first.
FIRST_BITS, SURE_BITS, BANDS = 16, 53, (76, 105)
#: Distinct shingles that a text must have for its fingerprint alone to be believed.
SURE_SHINGLES = 64
#: Rows that go to Python at a time where a row is two texts, and where it is two blocks of texts.
PAIR_ROWS, BLOCK_ROWS = 1000, 16
#: Row keys that may be broadcast (16 bytes each).
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the word shingles of a text, repeats included; fewer words are one shingle, none have none."""
    words = text.translate(LOWER).split()
    if len(words) < width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=np.uint64)


def _stream(h: np.ndarray, k: int) -> np.ndarray:
    """Another hash of each of h."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(h: np.ndarray) -> np.ndarray:
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 14):
        total += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return 2 * total > len(h)


def wide_fingerprint(h: np.ndarray) -> tuple[int, np.ndarray]:
    """Of the distinct shingle hashes of a text: 64 bits, and the bits of the wide fingerprint, from hashes of the hashes. Of repeats it would tell what is repeated, and not how much of the sets is shared."""
    size = SEGMENTS * SEGMENT_BITS
    wide = np.concatenate([_majority(_stream(h, k)) for k in range(1, -(-size // 64) + 1)])[:size]
    return int(np.packbits(_majority(h), bitorder="little").view("<u8")[0]), wide


def _numbers(bits: np.ndarray, size: int) -> list[int]:
    return (bits.reshape(-1, size) @ (1 << np.arange(size))).tolist()


def set_name(h: np.ndarray) -> int:
    """64 bits that name a set of shingles, given in order: texts of one name have the same shingles."""
    return xxhash.xxh3_64_intdigest(np.ascontiguousarray(h).tobytes())


def wide_fingerprints(docs: DataFrame, text_col: str, keep: list[str], width: int = SHINGLE_WORDS) -> DataFrame:
    """Adds fp (the name of the set of shingles, which is what a node is known by), print (64 bits of its fingerprint), segments, marks and n_shingles of each text, all of distinct shingles."""

    def make():
        def kernel(texts: list[bytes]) -> list[pa.Array]:
            hashes = [np.unique(shingle_hashes(t, width)) for t in texts]
            prints = [wide_fingerprint(h) for h in hashes]
            names = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in ([set_name(h) for h in hashes], [x for x, _ in prints])]
            cut = [pa.array([_numbers(x, size) for _, x in prints], pa.list_(pa.int32())) for size in (SEGMENT_BITS, MARK_BITS)]
            return [*names, *cut, pa.array([len(h) for h in hashes], pa.int32())]

        return kernel

    numbers = T.ArrayType(T.IntegerType())
    fields = [T.StructField("fp", T.LongType()), T.StructField("print", T.LongType()), T.StructField("segments", numbers), T.StructField("marks", numbers), T.StructField("n_shingles", T.IntegerType())]
    return append_columns(docs, text_col, make, fields, keep)


def _measured(found: DataFrame, firsts: DataFrame, similarity: float) -> DataFrame:
    """Of pairs (a, b) of prints those of nodes that may be so similar: the fp of both, the bits of their wide fingerprints that differ, and the smaller number of shingles. firsts: a node for each print."""
    side = lambda c: firsts.select(F.col("print").alias(c), F.col("fp").alias(f"fp_{c}"), F.col("segments").alias(f"segments_{c}"), F.col("n_shingles").alias(f"n_{c}"))
    both = found.join(side("a"), "a").join(side("b"), "b")
    least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    bits = F.aggregate(F.zip_with("segments_a", "segments_b", _apart), F.lit(0), lambda x, y: x + y)
    # sets of which one is smaller than the similarity asks for cannot be so similar
    return both.where(least >= F.lit(similarity) * most).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"), bits.alias("bits"), least.alias("n_least")).where(F.col("bits") <= BANDS[-1])


def firsts_of_prints(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes without those whose print another has as well, of which the one with the smallest fp stays; and pairs (a, b) of that one and each of the others, few as a rule."""
    shared = nodes.groupBy("print").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    others = written(nodes.select("print", F.col("fp").alias("b")).join(shared, "print").where("a <> b").select("a", "b"), "others")
    return nodes.join(others.select(F.col("b").alias("fp")), "fp", "left_anti"), others


def _standing(one: Column) -> list[Column]:
    """Of the rows (fp, mark, n_shared) of a mark, one of each row that stands for it. What is told of parts of the rows can be told again of what they gave."""
    return [F.max_by(one, F.struct("n_shared", "fp")), *(F.min_by(one, F.xxhash64("fp", "mark", F.lit(k))) for k in range(MIDDLES))]


def _middles_of_parts(rows: DataFrame) -> DataFrame:
    """(mark, middles) of marks with many nodes: each is dealt out as plain rows, some FEW_NODES a part, and only those that stand for a part meet. A partial aggregate in place would send eight names and hashes for nearly every row."""
    dealt = rows.select("fp", "mark", "n_shared", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / FEW_NODES)).alias("part")).repartition("mark", "part")
    told = dealt.groupBy("mark", "part").agg(F.array_distinct(F.array(*_standing(F.struct("fp", "n_shared")))).alias("one"))
    told = told.select("mark", F.explode("one").alias("one")).select("mark", "one.fp", "one.n_shared")
    return told.groupBy("mark").agg(F.array_distinct(F.array(*_standing(F.col("fp")))).alias("middles"))


def pairs_with_middles(firsts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of each node of firsts_of_prints() with the nearest few of those that stand for the nodes with one of its marks: as many at most, however large a group is.

    For a mark stand the node that shares its marks with most others, which in a group of copies of one text is that text or close to it, and some by chance.
    """
    marks = firsts.select(F.col("print").alias("fp"), F.posexplode("marks").alias("number", "mark")).select("fp", (F.col("number") * F.lit(1 << MARK_BITS) + F.col("mark")).alias("mark"))
    often = marks.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    # a node has MARKS rows at most
    central = F.sum("n").over(Window.partitionBy("fp"))
    shared = written(marks.join(often, "mark").select("fp", "mark", "n", central.alias("n_shared")), "marks")
    # dealt out before the frames, whose hashes would else be made first and sent along
    few = Window.partitionBy("mark")
    middles = F.array_distinct(F.array(*(x.over(few) for x in _standing(F.col("fp")))))
    usual = shared.where(F.col("n") <= FEW_NODES).select("fp", "mark", "n_shared").repartition("mark").withColumn("middles", middles).select("fp", "middles")
    crowded = shared.where(F.col("n") > FEW_NODES)
    shared_by = usual.unionByName(crowded.join(_middles_of_parts(crowded), "mark").select("fp", "middles"))
    far = F.transform("middles", lambda x: F.struct(_apart(F.col("fp"), x).alias("d"), x.alias("b")))
    met = shared_by.select("fp", F.filter(far, lambda x: (x.d <= FIRST_BITS) & (x.b != F.col("fp"))).alias("met")).where(F.size("met") > 0)
    near = met.groupBy("fp").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("met")))), 1, NEAREST).alias("met"))
    found = written(_measured(near.select(F.col("fp").alias("a"), F.explode("met.b").alias("b")), firsts, similarity), "pairs")
    forget(shared)
    return found


def similar_pairs(firsts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the fp of nodes of firsts_of_prints(), of different groups, that have a segment in common but for one bit and may be so similar."""
    known = firsts.select(F.col("print").alias("fp"), "segments", "group", "beside")
    found = _matches(known, F.col("segments"), SEGMENT_BITS, lambda a, b: _apart(a, b) <= FIRST_BITS, "group").distinct()
    return written(_measured(found, firsts, similarity), "pairs")


def jaccard(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) with the exact similarity of their sets of shingles; texts has fp and body."""
    both = pairs.select("a", "b").join(texts.select(F.col("fp").alias("a"), F.col("body").alias("left")), "a").join(texts.select(F.col("fp").alias("b"), F.col("body").alias("right")), "b")

    def run(batches):
        for piece in slices(batches, 2):
            out = []
            for x, y in zip(texts_of(piece.column(2)), texts_of(piece.column(3)), strict=True):
                x, y = np.unique(shingle_hashes(x, width)), np.unique(shingle_hashes(y, width))
                same = len(np.intersect1d(x, y, assume_unique=True))
                out.append(same / max(1, len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, similarity double")


@contextlib.contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """What is run inside sends so many rows to Python at a time: large rows in the usual number would fill an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _of_rows(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows joined to row keys, (file, place) and more: broadcast if they are few."""
    return rows.join(F.broadcast(keys) if small_enough(keys, BROADCAST_ROWS) else keys, ["file", "place"], how)


class _Groups:
    """Groups of nodes that grow by links."""

    def __init__(self, nodes: DataFrame, source: DataFrame, width: int, similarity: float):
        self.nodes, self.source, self.width, self.similarity = nodes, source, width, similarity
        self.edges: DataFrame | None = None
        self.member: DataFrame | None = None
        self.made: list[DataFrame] = []

    def add(self, edges: DataFrame) -> None:
        if self.edges is not None:
            edges = edges.unionByName(self.edges)
        edges = written(edges, "links")
        self.forget()
        self.edges, self.member = edges, components(edges)

    def forget(self) -> None:
        for done in (self.edges, self.member, *self.made):
            if done is not None:
                forget(done)
        self.made.clear()

    def rooted(self) -> DataFrame:
        """The nodes with the root of their group; null alone."""
        return self.nodes.join(self.member, F.col("fp") == F.col("node"), "left").drop("node")

    def texts(self, fps: DataFrame) -> DataFrame:
        """(fp, body) of the first text of each node."""
        keys = written(self.nodes.join(fps.distinct(), "fp", "left_semi").select("fp", "least.file", "least.place"), "keys")
        self.made.append(keys)
        return _of_rows(self.source.select("file", "place", "body"), keys, "inner").select("fp", "body")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose shingles are so similar."""
        ask = written(pairs.select("a", "b").distinct(), "ask")
        texts = self.texts(ask.select(F.col("a").alias("fp")).unionByName(ask.select(F.col("b").alias("fp"))))
        with _batches_of(self.nodes.sparkSession, PAIR_ROWS):
            found = written(jaccard(ask, texts, self.width).where(F.col("similarity") >= self.similarity).select("a", "b"), "found")
        forget(ask)
        return found

    def beside_large(self, near: DataFrame) -> DataFrame:
        """(fp, root): nodes outside a large group that are near one in it. near: pairs (a, b)."""
        size = self.member.groupBy("root").count().where(F.col("count") >= LARGE_GROUP).select("root")
        inside = self.member.join(size, "root").select("node", "root")
        both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = both.join(inside.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("fp"), "root").distinct()
        return written(met.join(inside.withColumnRenamed("node", "fp"), ["fp", "root"], "left_anti"), "beside")

    def in_blocks(self, beside: DataFrame) -> DataFrame:
        """Links (a, b) between nodes (fp, root) and all of the group: blocks of texts against blocks, so that no pair is a row and a group can be of any size."""
        inside = self.member.join(beside.select("root").distinct(), "root").select(F.col("node").alias("fp"), "root")

        def blocks(rows: DataFrame, name: str) -> DataFrame:
            n = rows.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
            dealt = rows.join(n, "root").select("fp", "root", F.pmod(F.xxhash64("fp"), F.col("n")).alias("block")).join(self.texts(rows.select("fp")), "fp")
            one = F.struct("fp", F.coalesce("body", F.lit("")).alias("body"))
            return dealt.groupBy("root", "block").agg(F.collect_list(one).alias(name)).select("root", name)

        width, least = self.width, self.similarity

        def run(batches):
            for batch in batches:
                for left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sides = [[(x["fp"], set(shingle_hashes(x["body"].encode(), width).tolist())) for x in side] for side in (left, right)]
                    pairs = [(a, b) for a, x in sides[0] for b, y in sides[1] if least * max(len(x), len(y)) <= min(len(x), len(y)) and (n := len(x & y)) >= least * (len(x) + len(y) - n)]
                    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        met = blocks(beside, "l").join(blocks(inside, "r"), "root").select("l", "r")
        with _batches_of(self.nodes.sparkSession, BLOCK_ROWS):
            return written(met.mapInArrow(run, "a long, b long"), "found")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are not in one group."""
        root = lambda c: self.member.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
        both = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, one row of each group: the one with the smallest id, and of those the first.

    Texts are linked where the sets of their shingles have at least the similarity. First each text is compared with one in the middle of those around it, so that
    a large group of near copies is one group after a few pairs a text, and texts beside it are compared with all of it in blocks. Then all other candidates, which
    have a segment of the wide fingerprint at most one bit apart, are paired if they are not in one group yet. Those far within are believed; the others are verified by their shingles, nearer ones first. Rows are
    told apart by where they stand, so that only linked rows go: null or repeated ids do not make one document of different texts.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = placed(docs, "rows")
    own, body = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    source = rows.select("file", "place", F.col(own).alias("id"), F.col(body).alias("body"))
    prints = written(wide_fingerprints(source, "body", ["file", "place", "id"], width), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "file", "place"))
    nodes = written(prints.groupBy("fp").agg(first.alias("least"), F.first("print").alias("print"), F.first("segments").alias("segments"), F.first("marks").alias("marks"), F.max("n_shingles").alias("n_shingles")), "nodes")
    groups = _Groups(nodes, source, width, similarity)
    sure = (F.col("bits") <= SURE_BITS) & (F.col("n_least") >= SURE_SHINGLES)
    firsts, others = firsts_of_prints(nodes)
    near = pairs_with_middles(firsts, similarity)
    found = groups.verified(near.where(~sure).select("a", "b").unionByName(others))
    groups.add(near.where(sure).select("a", "b").unionByName(found))
    beside = groups.beside_large(near)
    own = beside.groupBy("fp").agg(F.collect_set("root").alias("beside"))
    numbered = written(groups.rooted().withColumn("group", F.coalesce("root", F.lit(0).cast("long"))).join(own, "fp", "left"), "numbered")
    forget(found)
    found = groups.in_blocks(beside)
    pairs = similar_pairs(numbered.join(others.select(F.col("b").alias("fp")), "fp", "left_anti"), similarity)
    groups.add(found.unionByName(pairs.where(sure).select("a", "b")))
    low = -1
    for high in BANDS:
        forget(found)
        found = groups.verified(groups.apart(pairs.where(~sure & (F.col("bits") > low) & (F.col("bits") <= high))))
        groups.add(found)
        low = high
    rooted = groups.rooted().select("fp", "least", F.coalesce("root", "fp").alias("root"))
    name = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    kept = written(rooted.join(name, "root").select("fp", "kept"), "kept")
    gone = written(prints.join(kept, "fp").where((F.col("file") != F.col("kept.file")) | (F.col("place") != F.col("kept.place"))).select("file", "place"), "gone")
    groups.forget()
    for done in (prints, nodes, others, near, beside, numbered, pairs, found, kept):
        forget(done)
    return _of_rows(rows, gone, "left_anti").select(*names).toDF(*docs.columns)
