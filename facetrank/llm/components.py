"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from facetrank.llm.common import join_hot
from facetrank.shared import write_once


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a stored table, with what tells it from another one; both by one job."""
    seen = Observation()
    sums = F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))
    pairs = write_once(edges.observe(seen, F.count(F.lit(1)).alias("n"), sums.alias("sum")), "edges")
    return pairs, (seen.get["n"], seen.get["sum"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge to another one; component is the smallest node reached.

    `edges` has long columns v and u. Alternating large-star and small-star steps, each an aggregate and a join, until
    every node points to its smallest one. Each round is written to the shared folder, which cuts the lineage.
    """
    pairs = edges.filter("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct()
    pairs, state = _written(pairs)
    before = None
    while state != before and state[0]:
        before = state
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Large star: the larger neighbours of a node go to the smallest of it and its neighbours.
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = join_hot(both, least, ["v"], F.xxhash64("u")).filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = large.filter("v <> u").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        steps = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            joined.select("v", F.col("m").alias("u")))
        pairs, state = _written(steps.filter("v <> u").distinct())
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        pairs.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
