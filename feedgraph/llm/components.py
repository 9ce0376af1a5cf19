"""Connected components of a table of links, by alternating star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedgraph.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links (a, b) -> (node, root): the smallest node that each linked node reaches.

    A large-star step ties each larger neighbour to the smallest one, a small-star step each smaller neighbour; the
    rounds grow with the logarithm of a component's diameter. Minima are aggregated before they meet the links, so a
    node with very many links is no single group."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges = scratch.keep(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
