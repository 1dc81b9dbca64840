"""Records whose separator may also stand within quotes, read from one file by many tasks.

A split cannot know whether it begins within quotes. Every split is therefore walked from both
states; what a split does to the state, one row each, is combined in file order, which gives the
state each one begins with. Only records that hold a separator are put together by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.session import fits_broadcast, lookup_size, write_scratch
from corpusloom.sources.positions import read_positioned, walk_states


def quote_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def read_quoted(spark: SparkSession, path: str, sep: str, outside: Column, inside: Column) -> DataFrame:
    """Records as ``(file, number, value)``, numbered from 1 within a file.

    The files are cut at ``sep`` into pieces ``value``; ``outside`` and ``inside`` are columns over
    a piece, whether it ends within quotes if it begins outside, or inside them. The files are
    scanned three times: for the states, for records of one piece, and for the pieces of others.
    They must not change in between; if the splits do, an error is raised.
    """
    pieces = read_positioned(spark, path, line_sep=sep).select(
        "file", F.col("position.split_start").alias("split_start"), F.col("position.row").alias("row"), "value"
    )
    pieces = pieces.withColumns({"a": outside, "b": inside})
    walked = pieces.withColumn("w", walk_states(F.xxhash64("file", "split_start"), F.col("a"), F.col("b")))
    ends = lambda state: F.when(state, F.col("b")).otherwise(F.col("a"))
    last = F.struct(ends(F.col("w.o")).alias("o"), ends(F.col("w.i")).alias("i"), "w.no", "w.ni")
    splits = _resolved(walked.groupBy("file", "split_start").agg(F.max_by(last, "row").alias("last")))
    splits = write_scratch(splits, "splits")
    if fits_broadcast(*lookup_size(splits)):
        splits = F.broadcast(splits)
    known = walked.join(splits, ["file", "split_start"], "left")
    begins = F.coalesce("begins_inside", F.raise_error(F.lit("the splits of the files have changed")).cast("boolean"))
    of = lambda inside_, outside_: F.when(F.col("begins"), inside_).otherwise(outside_)
    known = known.withColumn("begins", begins).select(
        "file", "split_start", "row", "value", "a", "b",
        of(F.col("w.i"), F.col("w.o")).alias("state"),
        (F.col("before") + of(F.col("w.ni"), F.col("w.no"))).alias("number"),
    )
    alone = ~F.col("state") & ~F.col("a")
    ordered = F.sort_array(F.collect_list(F.struct("split_start", "row", "value")))
    joined = known.filter(~alone).groupBy("file", "number").agg(
        F.array_join(F.transform(ordered, lambda p: p["value"]), sep).alias("value")
    )
    return known.filter(alone).select("file", "number", "value").unionByName(joined)


def _resolved(splits: DataFrame) -> DataFrame:
    """``(file, split_start, begins_inside, before)`` from what each split does to the state.

    A split that ends alike from either state fixes it, others keep or swap it: a split begins with
    the last fixed state, swapped as often as splits since then say. ``before`` counts the records
    that begin in earlier splits. A file has one row for each split here.
    """
    order = W.partitionBy("file").orderBy("split_start")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    swaps = (F.col("last.o") & ~F.col("last.i")).cast("int")
    counted = splits.withColumn("swaps", F.sum(swaps).over(order))
    fixed = F.when(F.col("last.o") == F.col("last.i"), F.struct(F.col("last.o").alias("state"), "swaps"))
    counted = counted.withColumns(
        {"fixed": F.last(fixed, ignorenulls=True).over(earlier), "so_far": F.coalesce(F.lag("swaps").over(order), F.lit(0))}
    )
    since = F.col("so_far") - F.coalesce("fixed.swaps", F.lit(0))
    counted = counted.withColumn(
        "begins_inside", (F.coalesce("fixed.state", F.lit(False)).cast("int") + since) % 2 == 1
    )
    records = F.when(F.col("begins_inside"), F.col("last.ni")).otherwise(F.col("last.no"))
    return counted.select(
        "file", "split_start", "begins_inside", F.coalesce(F.sum(records).over(earlier), F.lit(0)).alias("before")
    )
