"""Connected components of edge tables, by alternating large and small stars.

No step holds a node's neighbours together: each takes the least neighbour by an aggregation and
joins it back, so nodes with very many edges are no heavier than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.llm.common import stored


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    low = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = low.groupBy("u").agg(F.min("v").alias("m"))
    x = low.join(least, "u")
    return x.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b) long, but for each component's least node, which
    is its name. Self-loops and repeated edges change nothing; no edges, no rows."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component"))
        state = now
        e = stored(_small(_large(e)))
