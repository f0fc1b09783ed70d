"""Connected components of a table of links, by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.session import store_table


def _to_smallest(rows: DataFrame, keep_larger: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them and itself.

    The smallest is an aggregate (combined before the shuffle) joined back, so that a node with
    very many links is never one task's group.
    """
    least = rows.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = rows.join(least, "a")
    if keep_larger:
        return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.unionAll(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node of ``links`` (a, b).

    Each round is written to the shared folder; rounds end when a round changes nothing. Their
    number grows with the logarithm of the longest chain.
    """
    links = store_table(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both, keep_larger=True).where("a <> b").distinct()
        small = _to_smallest(large, keep_larger=False)
        links = store_table(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        state = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
        if state == before:
            break
        before = state
    tops = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(tops)
