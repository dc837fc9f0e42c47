"""Connected components of a link table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)").alias("x")).first()
    return row["n"], row["x"]


def connected_components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, component): each linked node with the smallest node it reaches.

    Alternating large-star and small-star rounds: every round reattaches each node's larger (then smaller)
    neighbours to its smallest one, so the graph turns into stars in a number of rounds that grows with the
    logarithm of the path lengths. Minima are written to the checkpoint folder before they are joined, so both
    sides of the join come from plain exchanges and Spark can split a node with very many neighbours over tasks.
    Self links and repeated links are harmless; rows with a null end are ignored. No links, no rows.
    """
    pairs = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = checkpointed(pairs)
    state = _state(edges)
    before = None
    while state[0] and state != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(larger.distinct())
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
