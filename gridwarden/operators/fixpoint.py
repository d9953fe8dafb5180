"""Least fixpoints over tables of edges: what seeds reach, in how few steps, and from which seed; and the same kept up to date when edges change.

Seeds are (scope, node, origin), edges (scope, src, dst), results (scope, node, hops, origin): the fewest steps from any seed, and the smallest origin among the seeds that are so near.
Nodes of different scopes never meet. Each round is a join of the edges with the nodes that the last round added (the frontier) and an anti-join with what is known: a scope of any size
is spread over all tasks, by node. Rounds are as many as the longest way, each written to the shared folder, which is where lineage ends; a frontier is small as a rule, and adaptive execution broadcasts it then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import forget, written

#: Tables of rounds that are read as they are; more are put together.
PILE = 12
NODE = ["scope", "node"]


class _Pile:
    """Rows that grow by tables."""

    def __init__(self, first: DataFrame):
        self.tables = [first]

    def rows(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return out

    def add(self, table: DataFrame) -> None:
        self.tables.append(table)
        if len(self.tables) > PILE:
            whole = written(self.rows(), "pile")
            forget(*self.tables)
            self.tables = [whole]


def _best(rows: DataFrame) -> DataFrame:
    """The least (hops, origin) of each node."""
    least = F.min(F.struct("hops", "origin"))
    return rows.groupBy(*NODE).agg(least.alias("s")).select(*NODE, "s.hops", "s.origin")


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """What is one edge further on."""
    here = frontier.select("scope", F.col("node").alias("src"), "hops", "origin")
    return edges.join(here, ["scope", "src"]).select("scope", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), "origin")


def settle(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, node, hops, origin) of all that seeds reach, seeds included with 0 hops; a written table."""
    frontier = written(_best(seeds.select(*NODE, F.lit(0).alias("hops"), "origin")), "round")
    known = _Pile(frontier)
    while not frontier.isEmpty():
        # nodes come in order of their hops, so that the first state of a node is its last
        new = written(_best(_step(frontier, edges)).join(known.rows().select(*NODE), NODE, "left_anti"), "round")
        known.add(new)
        frontier = new
    out = written(known.rows(), "reached")
    forget(*known.tables)
    return out


@dataclass
class Change:
    """A fixpoint after a change. reached: the new state; touched: (scope, node) of all nodes whose state was taken back or set; both written tables."""

    reached: DataFrame
    touched: DataFrame


def maintain(reached: DataFrame, seeds: DataFrame, edges: DataFrame, new_seeds: DataFrame, new_edges: DataFrame) -> Change:
    """settle(new_seeds, new_edges), made from reached, which is settle(seeds, edges), along the differences alone.

    What is gone is followed first: a node loses its state if an edge or seed that may have given it is gone, and so does all that may hang on it (more than need be: the rest of it comes back at once).
    Then what is left of their surroundings, and what is new, is followed as far as it betters a state. Rows far from any change take part in no exchange but as the side that a small one is joined to.
    """
    edge, seed = ["scope", "src", "dst"], [*NODE, "origin"]
    gone_edges = written(edges.select(*edge).join(new_edges.select(*edge), edge, "left_anti"), "gone")
    come_edges = written(new_edges.select(*edge).join(edges.select(*edge), edge, "left_anti").distinct(), "come")
    gone_seeds = seeds.select(*seed).join(new_seeds.select(*seed), seed, "left_anti")
    come_seeds = new_seeds.select(*seed).join(seeds.select(*seed), seed, "left_anti").distinct()
    zero = lambda rows: rows.select(*NODE, F.lit(0).alias("hops"), "origin")
    state = [*NODE, "hops", "origin"]

    # taken back: states that a gone edge or seed gave, and in rounds those that they gave
    at_gone = reached.select("scope", F.col("node").alias("src"), "hops", "origin").join(gone_edges, ["scope", "src"])
    gave = at_gone.select("scope", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops"), "origin").unionByName(zero(gone_seeds))
    frontier = written(reached.join(gave.distinct(), state, "left_semi"), "back")
    back = _Pile(frontier)
    while not frontier.isEmpty():
        gave = _step(frontier, edges.select(*edge)).distinct()
        frontier = written(reached.join(gave, state, "left_semi").join(back.rows().select(*NODE), NODE, "left_anti"), "back")
        back.add(frontier)
    lost = written(back.rows().select(*NODE), "lost")
    forget(*back.tables)
    base = reached.join(lost, NODE, "left_anti")

    # set again: from seeds, from what kept its state, and over new edges
    into = new_edges.select(*edge).join(lost.withColumnRenamed("node", "dst"), ["scope", "dst"], "left_semi").unionByName(come_edges).distinct()
    offers = _step(base, into).unionByName(zero(new_seeds.join(lost, NODE, "left_semi"))).unionByName(zero(come_seeds))
    better = _Pile(written(base.limit(0), "better"))
    while True:
        offers = _best(offers)
        now = _best(better.rows())
        held = lambda rows, name: rows.select(*NODE, F.struct("hops", "origin").alias(name))
        met = offers.join(held(base, "old"), NODE, "left").join(held(now, "set"), NODE, "left")
        own = F.struct("hops", "origin")
        frontier = written(met.where((F.col("old").isNull() | (own < F.col("old"))) & (F.col("set").isNull() | (own < F.col("set")))).select(*state), "better")
        if frontier.isEmpty():
            forget(frontier)
            break
        better.add(frontier)
        offers = _step(frontier, new_edges.select(*edge))
    put = written(_best(better.rows()), "put")
    whole = written(base.join(put.select(*NODE), NODE, "left_anti").unionByName(put), "reached")
    touched = written(lost.unionByName(put.select(*NODE)).distinct(), "touched")
    forget(*better.tables, gone_edges, come_edges, lost, put)
    return Change(whole, touched)


def settle_sql(seeds: str, edges: str, far: int) -> str:
    """settle() as a recursive query, for engines that remove duplicates in recursion; so many steps at most."""
    return f"""WITH RECURSIVE fx_seeds AS MATERIALIZED ({seeds}), fx_edges AS MATERIALIZED ({edges}),
      fx_walk AS (SELECT scope, node, 0 AS hops, origin FROM fx_seeds s UNION SELECT w.scope, e.dst, w.hops + 1, w.origin FROM fx_walk w JOIN fx_edges e ON w.scope = e.scope AND w.node = e.src WHERE w.hops < {far}),
      fx_least AS (SELECT scope, node, hops, origin, ROW_NUMBER() OVER (PARTITION BY scope, node ORDER BY hops, origin) AS place FROM fx_walk x)
      SELECT scope, node, hops, origin FROM fx_least l WHERE place = 1"""
