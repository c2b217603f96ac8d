"""Connected components by alternating large-star and small-star, on tables only.

Every round maps edges to edges: large-star links each larger neighbour of a node to the least one around it,
small-star each smaller neighbour and the node itself.  Both keep components whole and end in stars around the
least node.  Edges are written to the shared folder after each round; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meander.llm.common import materialised


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``u, v`` edges but the least of each component (it names itself)."""
    def clean(e):
        return e.where("u <> v").distinct()

    def mark(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    state = materialised(clean(edges.select("u", "v")), "edges")
    before = None
    while (now := mark(state)) != before:
        before = now
        if not now[0]:
            break
        state = materialised(clean(_small_star(clean(_large_star(state)))), "edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
