"""Connected components of a link table by alternating large-star and small-star rounds, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbena.llm.shared import materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the least node that is reachable.

    Each round links a node's larger neighbours, then its smaller ones, to its least neighbour, until every
    node hangs on its root. A round is written to the shared folder, so lost executors cost one round.
    """
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    n = edges.count()
    for _ in range(MAX_ROUNDS):
        if not n:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least neighbours are written: then both sides of the merge join are plain shuffles, and a hub is split
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        hung = both.filter("v > u").hint("merge").join(least, "u")
        large = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        before, edges = (edges, n), materialize(small, "links")
        n = edges.count()
        if n == before[1] and edges.join(before[0], ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
