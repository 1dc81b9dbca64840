"""Raw text dumps: articles one after another, each opened by a line with its URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as X
from corpusloom.session import fits_broadcast
from corpusloom.sources.positions import opens_file, read_positioned

_LINE_BREAK = r"\r\n|\r|\n"


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a dump as ``(file, position, value)``."""
    return read_positioned(spark, path)


def preview(lines: DataFrame, n: int = 30) -> DataFrame:
    """The first ``n`` lines in file order, stripped."""
    return (
        lines.orderBy("file", "position")
        .limit(n)
        .select("file", "position", X.strip("value").alias("line"))
    )


def segment_articles(spark: SparkSession, path: str, keep_last: bool = True) -> DataFrame:
    """Articles of a dump as ``(file, url, content)``, from one scan of the text.

    The record separator is the start of the next article, so that Hadoop's splitting of large
    files yields whole articles and no line is shuffled. Only a file's first record can still carry
    the prefix, or be a preamble, which is left out; the order of the scan tells which one it is.
    With ``keep_last=False`` the last article of every file is left out too, for dumps that may end
    in the middle of one; its position takes a second scan, as no split knows whether a later one
    has a record.
    """
    records = read_positioned(spark, path, line_sep="\n" + C.ARTICLE_PREFIX)
    marked = records.withColumn("is_first", opens_file(F.col("file"), F.col("position.split_start")))
    if not keep_last:
        marked = _without_last(marked, records)
    kept = marked.filter(~F.col("is_first") | X.is_article_start("value"))
    body = F.when(F.col("is_first"), F.substr("value", F.lit(len(C.ARTICLE_PREFIX) + 1))).otherwise(
        F.col("value")
    )
    lines = F.split(body, _LINE_BREAK)
    return kept.select(
        "file",
        X.remove_article_prefix(F.element_at(lines, 1)).alias("url"),
        X.join_lines(F.slice(lines, F.lit(2), F.size(lines))).alias("content"),
    )


def _without_last(marked: DataFrame, records: DataFrame) -> DataFrame:
    """All records but the last one of each file. Both scans belong to one query and thus number the
    records alike."""
    edges = records.groupBy("file").agg(F.max("position").alias("last"))
    # The driver has listed the files, so rows and bytes are known without a job.
    files = records.inputFiles()
    if fits_broadcast(len(files), sum(len(f.encode()) + 16 for f in files)):
        edges = F.broadcast(edges)
    return marked.join(edges, "file").filter(F.col("position") < F.col("last"))
