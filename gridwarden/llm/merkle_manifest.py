"""Merkle manifest of a dataset, with a proof for every row, by pointer jumping.

Rows are leaves, in one tree for each group (a language, say), in order of their id; the roots of these trees, in order of the group, are the leaves of a top tree. FANOUT consecutive nodes
make one node above. Every node holds the siblings that lie on its way to an ancestor, at first its parent; joining the table of nodes with itself puts the ancestor's own siblings
behind, which doubles the distance, until all have reached the root. Leaves go with the node above them, and are taken apart from it at the end.

Scale: places of leaves come from a range-partitioned table and counts of its parts, so that a group of any size is spread over all tasks; windows are over parts of the table, not over rows.
A level is one exchange of an eighth of the level below, and a node never has more than FANOUT below it. Of the self-joins, log2 of the height are needed, over inner nodes alone, an eighth of the rows. Many nodes
have one ancestor only near the top, where ancestors are few: these are broadcast while their size, known by rows and height, is within BROADCAST_BYTES. Only built-in functions are used.

Defined cases: a null of any column has a hash of its own, also next to an empty text; null groups come first and null ids first in their group; rows of equal group and id are in order of their hashes, and equal rows,
which nothing tells apart, get a place each; a group of one row has its leaf as root, and so has a table of one; an empty table gives no rows; very long texts are hashed as they are. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, small_enough, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of nodes, or of counts, that may be broadcast.
BROADCAST_BYTES = 16 << 20
#: The top tree among the numbers of trees.
TOP = -1

_NODE = ("tree", "level", "pos")


def hashed(*inputs: Column) -> Column:
    """SHA-256 of the inputs one after the other, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*inputs), 256))


def shown(digest: Column) -> Column:
    """Digests as text, in lower case."""
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _joined(digests: Column) -> Column:
    """Digests of an array, one after the other."""
    return F.aggregate(digests, F.lit(b""), lambda a, x: F.concat(a, x))


def _height(n: Column) -> Column:
    """Levels above n leaves."""
    return sum((n > F.lit(FANOUT**k)).cast("int") for k in range(21))


def _placed_leaves(leaves: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The leaves with the number of their tree, its height and their place in it; the trees (group, n_tree, tree, height); tables to forget.

    Leaves stand in a table in order of group and id, in parts: a leaf's place is what its group has in the parts before, and its distance from the group's first leaf of its part.
    """
    order = ["group", "id", "leaf", "now"]
    ordered = written(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "ordered")
    ordered_in = ordered.withColumn("own_part", F.shiftrightunsigned("seq", 33))
    parts = written(ordered_in.groupBy("group", F.col("own_part").alias("part")).agg(F.min("seq").alias("first"), F.count("*").alias("n")), "parts")
    trees = parts.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("n_tree")).withColumn("part", F.shiftrightunsigned("first", 33))
    # trees are numbered by where they start: after all that start in parts before, and within their part
    starts = trees.groupBy("part").count().selectExpr("part", "sum(count) OVER (ORDER BY part) - count AS before")
    trees = trees.join(starts, "part").selectExpr("group", "n_tree", "before + row_number() OVER (PARTITION BY part ORDER BY first) - 1 AS tree")
    trees = written(trees.withColumn("height", _height(F.col("n_tree"))), "trees")
    before = parts.selectExpr("group AS g", "part", "first", "coalesce(sum(n) OVER (PARTITION BY group ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    known = before.join(trees, F.col("g").eqNullSafe(F.col("group"))).select("g", "part", "first", "before", "tree", "height")
    known = F.broadcast(known) if small_enough(parts, BROADCAST_BYTES // 256) else known
    rows = ordered_in.join(known, F.col("group").eqNullSafe(F.col("g")) & (F.col("own_part") == F.col("part")))
    placed = rows.select("id", "leaf", "now", "tree", "height", (F.col("before") + F.col("seq") - F.col("first")).alias("pos"))
    return placed, trees, [ordered, parts, trees]


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables of the nodes above nodes (tree, height, level, pos, digest) of one level, a level each, with what is below them: kids, an array of digests."""
    made = []
    for _ in range(height):
        above = nodes.where("level < height").groupBy("tree", "height", (F.col("level") + 1).alias("level"), F.floor(F.col("pos") / FANOUT).alias("up"))
        runs = above.agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("kids")).withColumn("kids", F.col("kids.digest"))
        runs = runs.select("tree", "height", "level", F.col("up").alias("pos"), "kids", hashed(shown(_joined(F.col("kids")))).alias("digest"))
        made.append(written(runs, "level"))
        nodes = made[-1].drop("kids")
    return made


def _siblings(kids: Column, i: Column) -> Column:
    """What lies to the left and to the right of kid i, counted from 0."""
    return F.struct(_joined(F.slice(kids, F.lit(1), i)).alias("left"), _joined(F.slice(kids, i + 2, F.greatest(F.lit(0), F.size(kids) - i - 1))).alias("right"))


def _known_as(tree: Column, height: Column, level: Column, pos: Column) -> list[Column]:
    """The one name of a node: the root of a group's tree is a leaf of the top tree."""
    root = (tree != TOP) & (level == height)
    return [F.when(root, TOP).otherwise(tree).cast("long").alias("tree"), F.when(root, 0).otherwise(level).cast("int").alias("level"), F.when(root, tree).otherwise(pos).cast("long").alias("pos")]


def _paths(levels: list[DataFrame], height: int) -> DataFrame:
    """Of each inner node but the root: its name, and the siblings from it to the root. levels: tables of nodes with their kids, but for those whose kids are rows."""
    steps = None
    for runs in levels:
        each = runs.select("tree", "height", "level", "pos", "kids", F.posexplode("kids").alias("i", "own"))
        name = [F.col("tree"), (F.col("level") - 1).cast("int").alias("level"), (F.col("pos") * FANOUT + F.col("i")).cast("long").alias("pos")]
        up = F.struct(*_known_as(F.col("tree"), F.col("height"), F.col("level"), F.col("pos"))).alias("up")
        subroot = F.when((F.col("tree") == TOP) & (F.col("level") == 1), F.col("own")).alias("subroot")
        step = each.select(*name, up, F.array(_siblings(F.col("kids"), F.col("i"))).alias("path"), subroot)
        steps = step if steps is None else steps.unionByName(step)
    now = written(steps, "paths")
    # a node's siblings on all levels, and its name
    limit = BROADCAST_BYTES // (height * (FANOUT - 1) * 32 + 128)
    while True:
        going = now.where("up IS NOT NULL")
        aims = written(going.select("up.*").distinct(), "aims")
        if small_enough(aims, 0):
            forget(aims)
            return now
        there = now.join(aims, list(_NODE), "left_semi").select(F.struct(*_NODE).alias("aim"), F.col("up").alias("next"), F.col("path").alias("more"), F.col("subroot").alias("found"))
        there = F.broadcast(there) if small_enough(aims, limit) else there
        far = going.join(there, F.col("up") == F.col("aim"), "left")
        path = F.concat("path", F.coalesce("more", F.slice("path", F.lit(1), F.lit(0))))
        far = far.select(*_NODE, F.col("next").alias("up"), path.alias("path"), F.coalesce("subroot", "found").alias("subroot"))
        later = written(now.where("up IS NULL").unionByName(far), "paths")
        forget(now)
        forget(aims)
        now = later


def prove(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, now: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per document: id_col, leaf, subroot, root (hex), path (siblings left and right of its way to the root, from below), proof_sha256, folded_root and verified.

    Leaves are hashes of fields. now: columns as they are found at verification; folded_root is what a leaf of these and the proof of the others lead to, and verified whether that is the root.
    """
    values = [F.col(f"`{f}`") for f in fields]
    changed = [(now or {}).get(f, v) for f, v in zip(fields, values, strict=True)]
    leaf = hashed(*map(field, values))
    again = hashed(*map(field, changed)) if now else F.lit(None).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("group"), leaf.alias("leaf"), again.alias("now"))
    rows = written(rows.withColumn("now", F.when(F.col("now") != F.col("leaf"), F.col("now"))), "leaves")
    kind = docs.schema[id_col].dataType.simpleString()
    leaves, trees, done = _placed_leaves(rows)
    size = trees.agg(F.count("*"), F.max("height")).first()
    if not size[0]:
        shape = f"`{id_col}` {kind}, leaf string, subroot string, root string, path array<struct<left: binary, right: binary>>, proof_sha256 string, folded_root string, verified boolean"
        return docs.sparkSession.createDataFrame([], shape)
    # the nodes above leaves keep the rows themselves; a leaf that is alone in its tree is such a node, without a level between
    own = F.struct("pos", "id", "leaf", "now")
    first = leaves.groupBy("tree", "height", F.floor(F.col("pos") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(own)).alias("kids"))
    level = F.least(F.lit(1), F.col("height"))
    digest = F.when(F.col("height") > 0, hashed(shown(_joined(F.col("kids.leaf"))))).otherwise(F.element_at("kids.leaf", 1))
    first = written(first.select("tree", "height", level.alias("level"), F.col("up").alias("pos"), "kids", digest.alias("digest")), "first")
    inner = _levels(first.drop("kids"), max(0, size[1] - 1))
    roots = first.drop("kids").where("level = height")
    for runs in inner:
        roots = roots.unionByName(runs.drop("kids").where("level = height"))
    top_height = next(k for k in range(22) if FANOUT**k >= size[0])
    bases = written(roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(top_height).alias("height"), F.lit(0).alias("level"), F.col("tree").cast("long").alias("pos"), "digest"), "roots")
    top = _levels(bases, top_height)
    root = (top[-1] if top else bases).select("digest").first()[0]
    known = _known_as(F.col("tree"), F.col("height"), F.col("level"), F.col("pos"))
    named = first.select(*known, "kids", (F.col("level") == 0).alias("lone"))
    if inner or top:
        paths = _paths([*inner, *top], size[1] + top_height)
        named = named.join(paths.select(*_NODE, "path", "subroot"), list(_NODE), "left")
    else:
        paths = None
        named = named.select("*", F.lit(None).cast("array<struct<left: binary, right: binary>>").alias("path"), F.lit(None).cast("binary").alias("subroot"))
    for table in (rows, *done, *inner, *top, bases):
        forget(table)
    each = named.select("*", F.posexplode("kids").alias("i", "own"))
    none = F.array().cast("array<struct<left: binary, right: binary>>")
    beside = F.when(F.col("lone"), none).otherwise(F.array(_siblings(F.col("kids.leaf"), F.col("i"))))
    out = each.select("own.*", F.coalesce("subroot", F.lit(root)).alias("subroot"), F.concat(beside, F.coalesce("path", none)).alias("path"))
    proof = F.sha2(shown(F.aggregate("path", F.lit(b""), lambda a, x: F.concat(a, x.left, x.right))), 256)
    folded = F.aggregate("path", shown(F.coalesce("now", "leaf")), lambda a, x: F.sha2(F.concat(shown(x.left), a, shown(x.right)), 256))
    text = shown(F.lit(root))
    out = out.select(F.col("id").alias(id_col), shown(F.col("leaf")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), text.alias("root"), "path", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """The columns of the registered query at verification: of one document in three, by the hash of its id, the text has A-Z in lower case."""
    hit = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 0
    low = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return {text_col: F.when(hit, low).otherwise(F.col(f"`{text_col}`"))}


def oracle_sql() -> str:
    """DuckDB SQL for the rows of the query. Trees of up to 8^7 leaves and 8^3 languages, which the tables of the check are far below."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    # CRC-32, a byte and then eight shifts at a time; -1 stands for a shift
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END))"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""given AS (SELECT doc_id, lang, CASE WHEN doc_id IS NOT NULL AND ({crc}) % 3 = 0 THEN {lower} ELSE text END AS seen, source, n_chars, text FROM documents),
leaves AS (SELECT doc_id, lang, sha256({" || ".join(map(field, FIELDS))}) AS leaf, sha256({" || ".join(field("seen" if c == "text" else c) for c in FIELDS)}) AS present FROM given),
l0 AS (SELECT doc_id, lang, leaf, present, leaf AS digest, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, present) - 1 AS id0 FROM leaves),
n0 AS (SELECT lang, id0 AS pos, digest, count(*) OVER (PARTITION BY lang) AS n FROM l0)"""
    ]

    def level(k: int, key: str, name: str) -> str:
        by = f"{key}, " if key else ""
        kids = f"{name}g{k} AS (SELECT {by}pos // 8 AS up, array_agg(digest ORDER BY pos) AS kids, any_value(n) AS n FROM {name}{k} GROUP BY {by}pos // 8)"
        up = f"{name}{k + 1} AS (SELECT {by}up AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS digest, count(*) OVER ({f'PARTITION BY {key}' if key else ''}) AS n FROM {name}g{k})"
        return f"{kids},\n{up}"

    parts += [level(k, "lang", "n") for k in range(7)]
    parts.append("t0 AS (SELECT row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, lang, digest, count(*) OVER () AS n FROM n7)")
    parts.append("subs AS (SELECT lang, pos AS sub, digest AS subroot FROM t0)")
    parts += [level(k, "", "t") for k in range(3)]
    steps = [("n", k, "x.lang IS NOT DISTINCT FROM g.lang AND ") for k in range(7)] + [("t", k, "") for k in range(3)]
    cur = "p0 AS (SELECT l0.doc_id, l0.lang, leaf, present AS folded, '' AS proof, id0, sub, subroot FROM l0 JOIN subs ON l0.lang IS NOT DISTINCT FROM subs.lang)"
    parts.append(cur)
    for j, (name, k, same) in enumerate(steps):
        place = f"(x.{'id0' if name == 'n' else 'sub'} // {8**k})"
        left, right = f"array_to_string(g.kids[1:({place} % 8)], '')", f"array_to_string(g.kids[({place} % 8) + 2:], '')"
        parts.append(
            f"p{j + 1} AS (SELECT x.doc_id, x.lang, leaf, CASE WHEN g.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded, CASE WHEN g.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, id0, sub, subroot FROM p{j} x JOIN {name}g{k} g ON {same}g.up = {place} // 8)"
        )
    body = ",\n".join(parts)
    return f"WITH {body}\nSELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM p{len(steps)}, t3"
