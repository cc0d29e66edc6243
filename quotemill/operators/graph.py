"""Connected components, for equivalences that no closed form covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill import store


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to the least of the node and its neighbours; a hub's edges are aggregated, not collected."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, go to the least of them. ``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: a node has one parent or is one, never both."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return not ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up * down > 0").limit(1).count()


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) but the roots: the least node that it can reach.

    Large and small stars by turns, so a chain of n nodes takes about log n rounds. Each round is
    written to the shared folder, and the round before goes.
    """
    spark = edges.sparkSession
    now, path = store.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        fresh, at = store.materialize(_small(_large(now)), "links")
        store.release(spark, path)
        now, path = fresh, at
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b)."""
    found = roots(edges).select("node", F.col("root").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
