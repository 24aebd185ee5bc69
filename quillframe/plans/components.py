"""Connected components of a graph that may be as large as the corpus, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.plans.scratch import durable


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every end of a link; a component is its smallest node.

    Large-star and small-star steps (Kiveris et al., 2014) alternate until the links are stars that no step changes.
    Each step is an aggregation and a join on a node, whose rows Spark can split for a hub; the driver sees two
    numbers a round, and each round's links are written to the shared folder.
    """
    edges = durable(links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low < high").distinct())
    state = None
    while True:
        both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
        lows = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(lows, "u").select(F.col("m").alias("low"), F.col("v").alias("high")).where("low < high").distinct()
        lows = large.groupBy("high").agg(F.min("low").alias("m"))
        small = large.join(lows, "high")
        small = small.select(F.col("m").alias("low"), F.col("low").alias("high")).unionAll(small.select(F.col("m").alias("low"), "high"))
        edges = durable(small.where("low < high").distinct())
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    nodes = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return nodes.unionAll(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
