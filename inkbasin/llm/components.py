"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbasin.llm.common import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b); nodes without an edge to another are left out.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest one, then its
    smaller neighbours (and itself) to its smallest. Aggregates combine before shuffling, so a node with very many
    neighbours costs no task more than its share of the edges; each round's edges are stored.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e"))
        last = now
        now = stored(small.select(F.col("e.x").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct(), "edges")
        dropped(last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    least = now.groupBy("a").agg(F.min("b").alias("component"))
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return least.select(F.col("a").alias("node"), "component").unionAll(roots.join(least.select(F.col("a").alias("node")), "node", "left_anti"))
