"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the smallest node of its component.

    Each round hooks the larger neighbours of every node to its smallest neighbour (large star), then the
    smaller ones (small star); the number of rounds grows with the logarithm of the diameter. Edges are
    distinct after every step, so a hub of any degree costs one row per neighbour, never pairs of
    neighbours. The lineage is cut in the shared checkpoint folder each round. Self loops keep their node;
    null ends are dropped; an empty table gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    signature = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if signature == tuple(now):
            break
        signature = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _trimmed(e: DataFrame, rounds: int = 50) -> DataFrame:
    """Edges without those that can't lie on a cycle because an end has nothing before or behind it; layers beyond the
    rounds stay, which costs rows and no result."""
    size = e.count()
    for _ in range(rounds):
        e = cut(e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u", "v"))
        now = e.count()
        if now == size:
            break
        size = now
    return e


def strongly_connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 1000) -> DataFrame:
    """Rows (node, component) for the nodes of every strongly connected component of two nodes or more; component is its smallest node.

    By trimming and colouring: what has no edge before or behind it is taken away; every node takes the smallest node
    that reaches it as its colour; those of a colour that reach its root are one component. They are taken away and the rest
    goes on, so that every round of colours finds a component for each of them. No task holds more than rows of
    edges, whatever the size of a component. The rounds of spreading grow with the length of the paths. Self loops, null ends and
    repeated edges do no harm; a graph without cycles gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = _trimmed(cut(e))
    found = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        colour = cut(e.select(F.explode(F.array("u", "v")).alias("x")).distinct().withColumn("c", F.col("x")))
        for _ in range(max_rounds):
            # a smaller colour of a node before it, if there is one
            better = e.join(colour.select(F.col("x").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("m"))
            spread_on = cut(colour.join(better, colour.x == better.v, "left").select("x", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("new")))
            some = not spread_on.where("new").isEmpty()
            colour = spread_on.select("x", "c")
            if not some:
                break
        # backwards from the roots, within their colours
        inner = cut(e.join(colour.select(F.col("x").alias("u"), F.col("c").alias("cu")), "u").join(colour.select(F.col("x").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv").select("u", "v", F.col("cu").alias("c")))
        reach = front = cut(colour.where("x = c").select("x", "c"))
        for _ in range(max_rounds):
            front = cut(inner.join(front.select(F.col("x").alias("v")), "v").select(F.col("u").alias("x"), "c").distinct().join(reach.select("x"), "x", "left_anti"))
            if front.isEmpty():
                break
            reach = reach.union(front)
        reach = cut(reach)
        several = reach.groupBy("c").count().where("count > 1").select("c")
        now = reach.join(several, "c", "left_semi").select(F.col("x").alias("node"), F.col("c").alias("component"))
        found = now if found is None else found.unionByName(now)
        gone = reach.select("x")
        e = _trimmed(cut(e.join(gone.withColumnRenamed("x", "u"), "u", "left_anti").join(gone.withColumnRenamed("x", "v"), "v", "left_anti").select("u", "v")))
    else:
        raise RuntimeError("components did not settle")
    if found is None:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("component")).where("false")
    return found
