"""Connected components by alternating large-star and small-star steps on an edge table.

Each step keeps the components and moves edges towards their smallest nodes; the table never grows
beyond the edges it began with.  Minima are pre-aggregated before the shuffle, and the joins are plain
equi-joins that adaptive execution may split where one node has very many edges.  After each round the
edges are written to the shared folder, which cuts the lineage.  The rounds end at the fixed point.

The edges are read in as many partitions as their number asks for (``EDGES`` each).  If that is one,
neither step shuffles, and a round is a single small task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged

#: edges (16 bytes each) that one partition may hold
EDGES = 400_000


def _toward(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest of u and its neighbours v as m."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def large_star(edges: DataFrame) -> DataFrame:
    """Connect each larger neighbour of a node with the smallest neighbour."""
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.explode(ways).alias("e")).select("e.u", "e.v")
    return _toward(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours with the smallest of them; edges have u > v."""
    ways = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return _toward(edges).select(F.explode(ways).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has two long columns.

    Self-loops, nulls and repeated edges are harmless; without edges the result is empty.
    """
    u, v = edges.columns
    now = staged(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "edges")
    mark, size = None, now.count()
    while True:
        now = now.coalesce(-(-size // EDGES) or 1)
        after = staged(small_star(large_star(now)), "edges")
        was, mark = mark, after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now, size = after, mark[0]
        if mark == was or not size:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
