"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved

#: Into so many parts the edges of a node are dealt.
SALTS = 8


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    Nodes are of one orderable type; null ends and loops are ignored.  Each step replaces a node's edges by edges to
    the smallest node next to it, which keeps components and at most the number of edges; the steps end when every
    edge points at its component's smallest node.  Labels are aggregated before each shuffle and joined back, so a
    node with very many neighbours is never gathered in one task: its edges lie by (node, salt), and so do copies of the
    label.
    """
    now = saved(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "edges",
    )
    salt, salts = F.expr(f"pmod(xxhash64(v), {SALTS})").cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    for _ in range(max_rounds):
        # Large star: every larger neighbour of x moves to the smallest node next to x.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), salts)
        large = both.where("v > u").select("*", salt).join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: x and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", salts)
        small = large.select("*", salt).join(least, ["u", "salt"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        now = saved(small, "edges", now)
        # Done when each node has one edge and no edge ends in a node that has one itself.
        ends = now.groupBy("u").agg(F.count("*").alias("n"), F.lit(0).alias("inner")).union(now.select(F.col("v").alias("u"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("inner")).distinct())
        open_nodes = ends.groupBy("u").agg(F.max("n").alias("n"), F.sum("inner").alias("inner")).where("n > 1 or (n > 0 and inner > 0)")
        if open_nodes.isEmpty():
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
