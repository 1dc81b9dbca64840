"""Connected components of a distributed graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import write_scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has a link to another one.

    ``edges`` is ``(a, b)`` of longs; ``component`` is the smallest node that can be reached.
    Every round hangs each neighbourhood below its smallest member, first the larger neighbours,
    then the smaller ones, until nothing changes; the number of rounds grows with the logarithm of
    the longest path. A hub's links are joined to its minimum, never gathered in one row. Rounds
    are written to the shared folder, so that a lost executor costs one round at most.
    """
    edges = write_scratch(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    seen = _digest(edges)
    while True:
        edges = write_scratch(_small_star(_large_star(edges)), "links")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.filter("u <> v").unionByName(least.withColumnRenamed("m", "v")).distinct()
