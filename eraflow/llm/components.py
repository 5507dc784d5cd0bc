"""Connected components of a link table by alternating star steps.

Each step links every neighbour of a node to the smallest node around it, first for the
larger neighbours, then for the smaller ones; the table turns into stars around the
components' smallest nodes in a number of steps that grows with the logarithm of the
longest path. Minima are aggregated before they are shuffled, and nothing is gathered
per node, so a node with very many links is only a skewed join key. No side of a join goes
through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eraflow.llm.common import by_shuffle, remove, store


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """``edges`` (a > b). Larger: each node's larger neighbours go to its smallest
    neighbour; else each node and its smaller neighbours do."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        moved = both.where("b > a").join(by_shuffle(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        moved = edges.join(by_shuffle(low), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(low.select("a", F.col("low").alias("b")))
    return moved.where("a > b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one link up to a node that has none."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")),
    )).alias("e"))
    counted = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    return counted.where("up > 1 OR (up = 1 AND down > 0)").isEmpty()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that can be
    reached. Links may repeat, point both ways or to
    themselves (a node with no other link is left out)."""
    spark = links.sparkSession
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = store(links.select(high, low).where("a > b").distinct(), f"{folder}/step-0")
    step = 0
    while not _all_stars(edges):
        step += 1
        edges = store(_stars(_stars(edges, True), False), f"{folder}/step-{step}")
        remove(spark, f"{folder}/step-{step - 1}")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
