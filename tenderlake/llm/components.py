"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import step
from .shared import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node reachable.

    Each round hangs the neighbours of a node under its smallest neighbour, with grouped minima and
    joins only, until nothing changes, which takes about log(n) rounds; a hub's links are split by
    the skew join, as the minima are written before. Of a round's tables only its links stay. Loops
    and repeated links do no harm.
    """
    links = links.where(F.col("a") != F.col("b"))
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-links")
    before = None
    while True:
        with step(links.sparkSession) as keep:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-low")
            large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            large = written(large.where(F.col("u") != F.col("v")).distinct(), f"{name}-large")
            low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low")
            small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = keep(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def same_document(held: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes which one document holds, of rows (id, node): a star each."""
    held = held.distinct()
    least = held.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b != last")
    return held.join(least, "id").where("node != b").select(F.col("node").alias("a"), "b")


def smallest_ids(nodes: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """node, component (the smallest node reachable) and least (the smallest id of its component) of
    those nodes (node, id) that have links."""
    linked = written(nodes.join(components(links, name), "node").select("node", "id", "component"), f"{name}-linked")
    return linked.join(linked.groupBy("component").agg(F.min("id").alias("least")), "component").select("node", "component", "least")
