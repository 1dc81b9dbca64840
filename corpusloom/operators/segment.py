"""Article segmentation of a table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.session import fits_broadcast, lookup_size, write_scratch
from corpusloom.sources.positions import running_count


def segment_lines(lines: DataFrame, keep_last: bool = True, parts: int | None = None) -> DataFrame:
    """Articles from ``(file, line_no, line)`` as ``(file, article_no, url, content)``.

    A running count over a file would put the file into one task, and one file may hold a third
    of all lines. The lines are therefore dealt into ranges of file and number, whatever the numbers
    are: sparse and huge ones make no more ranges than dense ones. Openings are counted within each
    range as it is written; a summary with one row for each range and file carries the count on.
    There are ``parts`` ranges, else as many as shuffles have partitions. Lines without file or
    number are left out; lines of equal number are ordered by their text. With ``keep_last=False``
    the last article of every file is left out.
    """
    rows = lines.filter("file is not null and line_no is not null").select(
        "file", "line_no", "line", F.coalesce(X.is_article_start("line"), F.lit(False)).alias("opens")
    )
    by = ("file", "line_no")
    ranged = rows.repartitionByRange(*by) if parts is None else rows.repartitionByRange(parts, *by)
    counted = ranged.sortWithinPartitions("file", "line_no", "line").withColumns(
        {"part": F.spark_partition_id(), "within": running_count(F.col("file"), F.col("opens"))}
    )
    counted = write_scratch(counted, "ranged-lines")
    summary = counted.groupBy("file", "part").agg(F.max("within").alias("opened"))
    earlier = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        "file",
        "part",
        F.coalesce(F.sum("opened").over(earlier), F.lit(0)).alias("before"),
        F.sum("opened").over(W.partitionBy("file")).alias("articles"),
    )
    carried = write_scratch(carried, "range-counts")
    if fits_broadcast(*lookup_size(carried)):
        carried = F.broadcast(carried)
    numbered = counted.join(carried, ["file", "part"]).withColumn("article_no", F.col("before") + F.col("within"))
    # Number 0 is what precedes the first article.
    kept = numbered.filter("article_no > 0")
    if not keep_last:
        kept = kept.filter("article_no < articles")
    body = F.sort_array(F.collect_list(F.when(~F.col("opens"), F.struct("line_no", "line"))))
    opening = F.max(F.when(F.col("opens"), F.col("line")))
    return kept.groupBy("file", "article_no").agg(
        X.remove_article_prefix(opening).alias("url"),
        X.join_lines(F.transform(body, lambda row: row["line"])).alias("content"),
    )
