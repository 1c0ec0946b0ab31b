"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

MOST_ROUNDS = 60


def marked(edges: DataFrame) -> tuple:
    """The number of edges and the sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of edges (a, b: long) the smallest node it is linked to, itself included.

    Large-star and small-star rounds until the edges are stars: a large-star changes nothing and no
    node has two smaller neighbours. Each round's edges and minima are written, so that both sides of
    a join are exchanged and a hub's edges can be split.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = marked(now)
    for _ in range(MOST_ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "large-star")
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "edges")
        if marked(large) == before and large.groupBy("a").count().filter("count > 1").isEmpty():
            forget(least, large)
            break
        least_2 = stored(large.groupBy("a").agg(F.min("b").alias("m")), "small-star")
        small = large.join(least_2, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = stored(least_2.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "edges")
        before = marked(after)
        forget(now, least, large, least_2)
        now = after
    else:
        raise RuntimeError("components didn't settle")
    found = stored(now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct(), "components")
    forget(now)
    return found
