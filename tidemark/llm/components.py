"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import stored


def smallest_reachable(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every linked id, the component being the smallest id it reaches.

    ``links`` has columns a and b. Rounds alternate between pointing larger and smaller neighbours of an id
    at the smallest one, until every id points at its root; each round is a stored table.
    """
    edges = stored(_ordered(links.select("a", "b")), "links")
    for _ in range(rounds):
        # Larger neighbours point at the smallest one around.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # Smaller neighbours point at the smallest of them.
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(root, "a")
        small = pairs.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(root.select("a", F.col("m").alias("b")))
        edges = stored(small.distinct(), "links")
        roots = edges.select(F.col("b").alias("a")).distinct()
        if edges.groupBy("a").count().where("count > 1").isEmpty() and edges.join(roots, "a", "left_semi").isEmpty():
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("id"), F.col("a").alias("component")))
    raise RuntimeError("components did not settle")


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
