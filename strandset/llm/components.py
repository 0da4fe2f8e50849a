"""Connected components of an edge table, without any graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): for each id in the edges (a, b) the smallest id of its component, by alternating large-star and
    small-star steps. Each round is written to the shared folder; two numbers a round reach the driver. A node's
    neighbours are never gathered: only their minimum is. The minima are written before they are joined, so that both
    sides of the join are dealt anew and adaptive execution can split a hot node."""
    now = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen, k = None, 0
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark.n, mark.s) == seen:
            break
        seen, k = (mark.n, mark.s), k + 1
        both = now.select(F.col("u"), F.col("v")).unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least-{k}")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionAll(now.join(least, "u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(down.select("u", F.col("m").alias("v")))
        after = scratch.keep(small.where("u != v").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-least-{k}")
        now = after
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("id"), "component").distinct())
