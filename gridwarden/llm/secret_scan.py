"""Secret scan with multipart credential linking; JVM expressions only.

Strong candidates are reported as they are: assignments to a name that says password, secret, token or key; access identifiers;
long hexadecimal runs. Weak ones, an identifier assignment, a mixed random-looking run or a network endpoint, say little
alone. They are reported only when complementary parts stand beside them, with at most SCOPE code points between end and start: an identifier with a
secret, a secret with an identifier, an endpoint with both. What overlaps a candidate is no complement of it, and a value that an
identifier assigns is no secret.

A pattern's matches and the gaps between them, from one pass each, give offsets as running sums. The interval join of the parts is a
range frame over their ends and starts in order of place: linear in the parts, with no pair made. Everything after the scan is keyed by a row number, so
there is one shuffle, of parts only; a text without parts sends one row.

Defined cases: null and empty texts have no spans; rows with null or repeated ids each keep their own spans. A very long text is one row of parts, in place order
within one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Fixed patterns of the strong kinds, in the order of their names in a list of spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
#: And of the weak ones.
IDENTIFIER = r"""(?i:client|account|access|user|tenant|app)[_-]?(?i:id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{4,}"""
MIXED = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/=_-]{0,64}[0-9])(?=[a-z0-9+/=_-]{0,64}[A-Z])(?=[A-Z0-9+/=_-]{0,64}[a-z])[A-Za-z0-9+/=_-]{32,}"
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""

KINDS = ["assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint"]
MIN_VALUE = 6
SCOPE = 400


def _cuts(text: Column, kind: int, pattern: str, met: Column, ok=None) -> Column:
    """For each match in order: its kind, number, the length of the gap before it, its length, and if it counts."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def row(gap, match):
        good = F.lit(True) if ok is None else ok(match)
        return F.struct(F.length(gap).cast("long").alias("gap"), F.length(match).cast("long").alias("len"), good.alias("ok"))

    made = F.filter(F.zip_with(gaps, matches, row), lambda x: x.len.isNotNull())
    numbered = F.transform(made, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.gap.alias("gap"), x.len.alias("len"), x.ok.alias("ok")))
    return F.when(met, numbered).otherwise(F.array().cast("array<struct<kind:int,pos:int,gap:bigint,len:bigint,ok:boolean>>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: id and spans, an array of (start, kind number, end, kind) in order; offsets in code points."""
    row = fresh("row", [id_col])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias(row))
    t = F.col("t")
    parts = F.concat(
        _cuts(t, 0, ASSIGN, t.rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_VALUE),
        _cuts(t, 1, ACCESS, t.contains("AKIA")),
        _cuts(t, 2, HEX, t.rlike(HEX)),
        _cuts(t, 3, IDENTIFIER, t.rlike(r"""(?i)(?:id)["']?\x20*[:=]""")),
        _cuts(t, 4, MIXED, t.rlike(MIXED)),
        _cuts(t, 5, ENDPOINT, t.contains("://")),
    )
    found = rows.select("id", row, F.explode_outer(parts).alias("p")).select("id", row, "p.*").repartition(F.col(row))
    before = Window.partitionBy(row, "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = found.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    # a value that an identifier assigns is no secret beside it
    order = Window.partitionBy(row).orderBy("start")
    of_id = lambda c: F.when(F.col("kind") == 3, F.col(c))
    inside = placed.withColumns({
        "id_before": F.max(of_id("end")).over(order.rangeBetween(Window.unboundedPreceding, 0)),
        "id_after": F.min(of_id("start")).over(order.rangeBetween(1, Window.unboundedFollowing)),
    })
    own = (F.col("kind") != 3) & (F.coalesce(F.col("id_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("id_after") < F.col("end"), F.lit(False)))
    # two edges of each part, in order of place: what ends before a part and what starts behind it, within the scope, lies beside it
    edges = inside.withColumn("own", own).withColumn("edge", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.when(F.col("edge") == 0, F.col("start")).otherwise(F.col("end")))
    place = Window.partitionBy(row).orderBy("at")
    behind, ahead = place.rangeBetween(-scope, 0), place.rangeBetween(0, scope)

    def beside(*kinds):
        good = F.col("ok") & F.col("kind").isin(*kinds) & ~F.col("own")
        some = lambda edge, frame: F.max(F.coalesce(good & (F.col("edge") == edge), F.lit(False))).over(frame)
        return F.when(F.col("edge") == 0, some(1, behind)).otherwise(some(0, ahead))

    marked = edges.withColumns({"by_id": beside(1, 3), "by_secret": beside(0, 2, 4)})
    linked = marked.groupBy(row, "kind", "pos").agg(*(F.first(c).alias(c) for c in ("id", "start", "end", "ok", "own")), F.max("by_id").alias("has_id"), F.max("by_secret").alias("has_secret"))
    told = (
        F.when(F.col("kind") <= 2, F.col("ok"))
        .when(F.col("kind") == 3, F.col("has_secret"))
        .when(F.col("kind") == 4, F.col("has_id") & ~F.col("own"))
        .when(F.col("kind") == 5, F.col("has_id") & F.col("has_secret"))
    )
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.when(told, F.struct("start", "kind", "end", name.alias("name")))
    out = linked.groupBy(row).agg(F.first("id").alias(id_col), F.array_sort(F.collect_list(span)).alias("spans"))
    return out.select(id_col, "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the strong kinds, a hash of their spans, and all spans as text."""
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["name"], x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("spans", lambda x: x.kind <= 2)
    count = lambda k: F.size(F.filter("spans", lambda x: x.kind == k)).cast("long")
    return found.select(
        id_col,
        *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)),
        F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )
