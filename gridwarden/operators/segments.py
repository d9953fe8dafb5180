"""Line operators for files of any length: a file's lines in segments, each worked on by itself, and what is carried from one to the next put together in a second step.

lines.py orders all lines of a file in one task, which is right for files as people write them. Generated, bundled and joined files have millions of lines. Here frames are over (doc_id, seg), SEGMENT lines each; per segment
a row says what it hands on (the last known value, the sum, the least indent), and windows over these rows, a line in so many, say what each segment starts with. Frames of neighbours get the few lines beside a segment as a rim.
Results are those of the operators of the same name in lines.py, which are their check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code_values as K
from ..functions.dialect import Dialect
from ..functions.run import apply
from ..functions.tables import forget, written
from . import lines as L

SEGMENT = 4096
KEY = ["doc_id", "seg"]


def _up_to():
    """The lines of a segment up to each."""
    return Window.partitionBy(*KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    """The segments of a file before each."""
    return Window.partitionBy("doc_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)


def cut(lines: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Lines with the number of their segment."""
    return lines.withColumn("seg", F.floor((F.col("line_no") - 1) / size).cast("int"))


def last_known(lines: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Lines with, by name, the last of each value up to the line that is not null."""
    own = lines.withColumns({f"own_{n}": v for n, v in values.items()})
    told = {n: F.max_by(f"own_{n}", F.when(F.col(f"own_{n}").isNotNull(), F.col("line_no"))).alias(n) for n in values}
    ends = own.groupBy(*KEY).agg(*told.values())
    before = ends.select(*KEY, *(F.last(n, True).over(_before()).alias(f"before_{n}") for n in values))
    inside = own.withColumns({f"own_{n}": F.last(f"own_{n}", True).over(_up_to()) for n in values})
    both = inside.join(before, KEY)
    return both.select(*lines.columns, *(F.coalesce(f"own_{n}", f"before_{n}").alias(n) for n in values))


def running_sum(lines: DataFrame, value: Column, into: str) -> DataFrame:
    """Lines with the sum of a value over all lines up to each."""
    own = lines.withColumn("own_step", value)
    before = own.groupBy(*KEY).agg(F.sum("own_step").alias("total")).select(*KEY, F.sum("total").over(_before()).alias("before_sum"))
    inside = own.withColumn("own_sum", F.sum("own_step").over(_up_to()))
    return inside.join(before, KEY).select(*lines.columns, (F.col("own_sum") + F.coalesce("before_sum", F.lit(0))).alias(into))


def rimmed(lines: DataFrame, before: int, after: int, size: int = SEGMENT) -> DataFrame:
    """Lines dealt out to the segments that see them (`seen_in`): their own, where they are `at_home`, and those of which a line has them among so many lines before it or after it."""
    at = F.col("line_no") - 1
    seen = F.sequence(F.greatest(F.lit(0), F.floor((at - after) / size).cast("int")), F.floor((at + before) / size).cast("int"))
    return lines.select(*lines.columns, F.explode(seen).alias("seen_in")).withColumn("at_home", F.col("seen_in") == F.floor(at / size))


def near(lines: DataFrame, text: str, before: int, after: int, into: str, size: int = SEGMENT) -> DataFrame:
    """Lines with the texts around, from so many lines before to so many after, one per line. A segment sees the lines beside it as a rim, which goes afterwards."""
    if max(before, after) > size:
        raise ValueError("a rim reaches over one neighbour only")
    frame = Window.partitionBy("doc_id", "seen_in").orderBy("line_no").rowsBetween(-before, after)
    framed = rimmed(lines, before, after, size).withColumn(into, F.array_join(F.collect_list(text).over(frame), "\n"))
    return framed.where("at_home").select(*lines.columns, into)


def _ends(d: Dialect, starts: str, rows: str) -> str:
    return f"SELECT doc_id, line_no, until FROM {L._ends(d, starts, rows)} e"


def block_ends(starts: DataFrame, lines: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(doc_id, line_no, until): for each start (doc_id, line_no, indent) the first later line that is indented no deeper; null if there is none.

    First within the start's segment; for blocks that stay open, the next segment that has such a line, by the least indents of segments; then the first such line in it.
    """
    keyed = lambda rows, seg="seg": rows.withColumn("doc_id", F.struct("doc_id", F.col(seg).alias("seg")))
    rows = lines.select("doc_id", "line_no", "indent", "seg")
    at = written(cut(starts.select("doc_id", "line_no", "indent"), size), "starts")
    found = apply(_ends, starts=keyed(at), rows=keyed(rows)).select("doc_id.doc_id", "line_no", "until")
    inside = written(at.join(found, ["doc_id", "line_no"]), "inside")
    low = rows.groupBy(*KEY).agg(F.min("indent").alias("indent")).select("doc_id", F.col("seg").alias("line_no"), "indent")
    open_ = inside.where("until IS NULL").select("doc_id", "indent", "seg").distinct()
    # a start of each depth at the segment it is open in; ends come back by segment and depth
    by_depth = lambda rows, depth: rows.withColumn("doc_id", F.struct("doc_id", F.col(depth).alias("depth")))
    levels = open_.select("doc_id", F.col("indent").alias("depth")).distinct()
    segments = low.join(levels, "doc_id").where(F.col("indent") <= F.col("depth"))
    nexts = apply(_ends, starts=by_depth(open_.select("doc_id", F.col("seg").alias("line_no"), "indent"), "indent"), rows=by_depth(segments, "depth").select("doc_id", "line_no", "indent"))
    nexts = written(nexts.where("until IS NOT NULL").select("doc_id.doc_id", F.col("doc_id.depth").alias("indent"), F.col("line_no").alias("seg"), F.col("until").alias("next_seg")).distinct(), "nexts")
    asked = nexts.select("doc_id", F.col("next_seg").alias("seg"), "indent").distinct()
    firsts = rows.withColumnRenamed("indent", "own").join(asked, KEY).where(F.col("own") <= F.col("indent")).groupBy(*KEY, "indent").agg(F.min("line_no").alias("first"))
    later = nexts.join(firsts.withColumnRenamed("seg", "next_seg"), ["doc_id", "next_seg", "indent"]).select("doc_id", "indent", "seg", "first")
    out = inside.join(later, ["doc_id", "indent", "seg"], "left").select("doc_id", "line_no", F.coalesce("until", "first").cast("int").alias("until"))
    out = written(out, "ends")
    forget(at, inside, nexts)
    return out


def parse(files: DataFrame, size: int = SEGMENT) -> DataFrame:
    """lines.parse() with segments, written: a file is cut into lines where it was read, and dealt out by segments from there on."""
    return _with_files(apply(L.marked, files=files), size)


def lines_of_parts(parts: DataFrame) -> DataFrame:
    """lines.marked() of files in parts (doc_id, place, part), joined by line feeds in order of place. Parts are no nulls, and places of a file differ. A file is never one row, so that it may be larger than a value can be.

    Parts are dealt out by ranges. Where a part's lines start is told by the parts before it in its range, and by the ranges before.
    """
    spark = parts.sparkSession
    ranges = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n_lines = F.length("part") - F.length(F.replace("part", F.lit("\n"))) + 1
    dealt = parts.select("doc_id", "place", "part", n_lines.cast("long").alias("n")).repartitionByRange(ranges, "doc_id", "place")
    stored = written(dealt.withColumn("range", F.spark_partition_id()), "parts")
    sums = stored.groupBy("doc_id", "range").agg(F.sum("n").alias("total"), F.min("place").alias("first"))
    earlier = Window.partitionBy("doc_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("doc_id", "range", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("doc_id", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, ["doc_id", "range"])
    keyed = starts.select(F.struct("doc_id", (F.col("before") + F.col("inside")).alias("start")).alias("doc_id"), F.col("part").alias("code"))
    alone = apply(L.marked, files=keyed)
    own = {"doc_id": F.col("doc_id.doc_id"), "line_no": (F.col("doc_id.start") + F.col("line_no")).cast("int")}
    return alone.select(*(own.get(c, F.col(c)).alias(c) for c in alone.columns))


def parse_parts(parts: DataFrame, size: int = SEGMENT) -> DataFrame:
    """parse() of files in parts, as lines_of_parts() takes them."""
    return _with_files(lines_of_parts(parts), size)


def _with_files(marked: DataFrame, size: int) -> DataFrame:
    """Lines of lines.marked() with the file that the last marker named, and segments, written."""
    alone = written(cut(marked, size), "marked")
    told = last_known(alone, {"file": F.col("mark")})
    out = written(told.withColumn("file", F.coalesce("file", F.lit("<input>"))).drop("mark"), "lines")
    forget(alone)
    return out


def enclosing(lines: DataFrame, other: str = "__global__") -> DataFrame:
    """lines.enclosing(): each line with the definition that it stands in or after."""
    found = apply(L.nodes, lines=lines).select("doc_id", "line_no", F.col("name").alias("def_name"))
    told = last_known(lines.join(found, ["doc_id", "line_no"], "left"), {"fn": F.col("def_name")})
    return told.drop("def_name").withColumn("fn", F.coalesce("fn", F.lit(other)))


def dead(lines: DataFrame, size: int = SEGMENT) -> DataFrame:
    """lines.dead(): (doc_id, line_no) of lines that cannot run."""
    ends = block_ends(apply(L.dead_starts, lines=lines), lines, size)
    steps = ends.select("doc_id", (F.col("line_no") + 1).alias("line_no"), F.lit(1).alias("step")).unionByName(ends.where("until IS NOT NULL").select("doc_id", F.col("until").alias("line_no"), F.lit(-1).alias("step")))
    summed = steps.groupBy("doc_id", "line_no").agg(F.sum("step").alias("step"))
    rows = lines.select("doc_id", "line_no", "seg").join(summed, ["doc_id", "line_no"], "left")
    return running_sum(rows, F.coalesce("step", F.lit(0)), "depth").where("depth > 0").select("doc_id", "line_no")


def _reach(d: Dialect, lines: str) -> str:
    """What each line says by itself: guards, what reaches it, and whether a pattern may begin in it that goes on in the next."""
    made = ", ".join(f"{v} AS {k}" for k, v in L.reach_flags(d, "raw").items())
    return f"SELECT doc_id, line_no, raw, {L.guard_level(d)} AS own_guard, {made}, {d.any('raw', K.REACH_HEADS)} AS head FROM {lines} l"


def _reached(d: Dialect, rows: str) -> str:
    """What the lines around say: one of them by itself, or, where a pattern may begin in one of them that goes on, their whole text."""
    made = ", ".join(f"near_{k} OR (around IS NOT NULL AND {v}) AS {k}" for k, v in L.reach_flags(d, "around").items())
    return L.who_reaches(d, f"(SELECT doc_id, line_no, {made}, CASE WHEN line_no - guard_line <= 40 THEN guard_level END AS level FROM {rows} r)")


def reachability(lines: DataFrame, size: int = SEGMENT) -> DataFrame:
    """lines.reachability(): who can reach each line. Of lines (doc_id, line_no, raw).

    Patterns look at each line once, and not at all lines around each: only where a line may be the start of a match over several lines are the lines around put together. Lines are dealt out once, with the 40 lines before a segment, in which a guard counts.
    """
    order = Window.partitionBy("doc_id", "seen_in").orderBy("line_no")
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = lambda c: F.when(c, F.col("line_no"))
    within = lambda c, n: F.coalesce(F.max(line(F.col(c))).over(order.rowsBetween(Window.unboundedPreceding, n)) >= F.col("line_no") - n, F.lit(False))
    rows = rimmed(apply(_reach, lines=lines), 40, 15, size)
    told = {f"near_{c}": within(c, 15) for c in ("is_dead", "dev_only", "internal", "head")}
    told |= {"guard_line": F.max(line(F.col("own_guard").isNotNull())).over(up_to), "guard_level": F.last("own_guard", True).over(up_to), "kept": F.when(within("head", 30), F.col("raw"))}
    rows = rows.withColumns(told)
    around = F.array_join(F.collect_list("kept").over(order.rowsBetween(-15, 15)), "\n")
    rows = rows.withColumn("around", around).where("at_home").withColumn("around", F.when(F.col("near_head"), F.col("around")))
    return apply(_reached, rows=rows)
