"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another one; edges are columns a and b.

    The root is the smallest node of the component. A round hooks larger neighbours of a node to
    its smallest neighbour, then smaller ones; rounds grow with the logarithm of the size. Each
    round ends in a written table, and only a count and a checksum come to the driver.
    """
    step = saved(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        mark = step.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == before or not mark[0]:
            return step.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        step = saved(small_star(large_star(step)))


def large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to the smallest of it and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .where("u != v")
        .distinct()
    )


def small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u != v")
        .union(least.select("u", F.col("m").alias("v")))
        .distinct()
    )
