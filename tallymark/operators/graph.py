"""Connected components by contraction towards random priorities, written each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .running import written

#: A node is heavy with over this share of all edges, and this many; there are twice as many heavy nodes as shares at most.
SHARES, LEAST_HEAVY = 1000, 10_000


def _relabelled(edges: DataFrame, end: str, to: DataFrame, heavy: DataFrame) -> DataFrame:
    """edges with the roots of one end in its place. Heavy nodes, of which there can be but a few, are looked up in a broadcast map."""
    names = edges.columns
    few = F.broadcast(to.join(F.broadcast(heavy), "node", "left_semi").toDF("_n", "_r"))
    d = edges.join(few, F.col(end) == F.col("_n"), "left").drop("_n")
    other = [c for c in names if c != end]
    near = d.where("_r is not null").select(*other, F.col("_r").alias(end))
    far = d.where("_r is null").drop("_r").join(to.toDF("_n", "_r"), F.col(end) == F.col("_n")).select(*other, F.col("_r").alias(end))
    return near.unionByName(far).select(*names)


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100, least_heavy: int = LEAST_HEAVY) -> DataFrame:
    """(node, component): component is the least node that can be reached.

    nodes has a column node, edges columns a and b; null ends link nothing. Each round every node points to the least of itself
    and its neighbours by a random priority, and the graph is contracted along the pointers; a constant share of the
    nodes that still have edges goes in each round. Only minima are taken by node, so a hub is combined before it is
    shuffled, and its edges are relabelled where they lie. Each round is written.
    """
    ends = [f("a", "b") for f in (F.least, F.greatest)]
    e = written(edges.where("a <> b").select(ends[0].alias("a"), ends[1].alias("b")).distinct())
    owner = None
    for k in range(most_rounds):
        both = e.union(e.select("b", "a")).toDF("a", "b")
        priority = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("v"))
        to = both.groupBy("a").agg(F.min(priority("b")).alias("p"), F.count(F.lit(1)).alias("degree"))
        to = written(to.select(F.col("a").alias("node"), F.least(priority("a"), F.col("p"))["v"].alias("root"), "degree"))
        total = to.agg(F.sum("degree")).first()[0]
        if not total:
            break
        heavy = to.where(F.col("degree") > max(total // SHARES, least_heavy)).select("node")
        to = to.select("node", "root")
        if owner is None:
            owner = to
        else:
            owner = written(owner.join(to.toDF("root", "_up"), "root", "left").select("node", F.coalesce("_up", "root").alias("root")))
        left = _relabelled(_relabelled(e, "a", to, heavy), "b", to, heavy).where("a <> b")
        e = written(left.select(ends[0].alias("a"), ends[1].alias("b")).distinct())
    else:
        raise RuntimeError(f"components are not finished after {most_rounds} rounds")
    nodes = nodes.select("node").where("node is not null").distinct()
    if owner is None:
        return nodes.select("node", F.col("node").alias("component"))
    low = owner.groupBy("root").agg(F.min("node").alias("component"))
    found = owner.join(low, "root").select("node", "component")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
