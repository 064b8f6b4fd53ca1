"""Connected components of a large graph by alternating stars: no task and no driver ever holds a component.

Each round links the larger neighbours of every node to the smallest neighbour (large star), then the smaller ones
(small star), until nothing changes; every node then hangs on the smallest node of its component.  A round is written
to the shared folder, so the lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faqloom.llm.common import join_counts
from faqloom.session import materialize


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) -> (u, v, low): low is the smallest of u and its v."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("rows"))
    low = low.withColumn("low", F.least("u", "low"))
    return join_counts(pairs, materialize(low, "component-low"), "u", "rows", ["low"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) between bigint nodes -> (node, root), root the smallest node of the component; only linked nodes."""
    a, b = F.col("a"), F.col("b")
    links = edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = materialize(links, "component-links")
    mark = _mark(links)
    while mark[0]:
        both = materialize(links.union(links.select("v", "u")).distinct(), "component-both")
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialize(large.filter("u != v"), "component-large")  # u > v
        small = _star(large)
        small = small.select("v", "low").union(small.select("u", "low")).toDF("u", "v").filter("u != v").distinct()
        links = materialize(small, "component-links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
