"""Article tables on disk: headerless tab-separated text for exchange, Parquet for volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.quoted import quote_count, read_quoted

ARTICLE_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType(), True),
        T.StructField("headline", T.StringType(), True),
        T.StructField("content", T.StringType(), True),
    ]
)

# Quotes are doubled inside quoted fields; tabs and line breaks may occur within quotes.
TSV_OPTIONS = {"sep": "\t", "quote": '"', "escape": '"', "header": "false"}


def read_articles(
    spark: SparkSession,
    path: str,
    keep_headline: bool = False,
    multi_line: bool = False,
    schema: T.StructType = ARTICLE_SCHEMA,
) -> DataFrame:
    """``(date, content)`` or, on request, ``(date, headline, content)``.

    A record is a line, as ``write_articles`` leaves it. With ``multi_line`` line breaks may lie
    within quoted fields, which begin and end with their field. Large files are split either way.
    """
    if multi_line:
        articles = _read_quoted_articles(spark, path, schema)
    else:
        articles = spark.read.csv(path, schema=schema, dateFormat="yyyy-MM-dd", **TSV_OPTIONS)
    return articles if keep_headline else articles.drop("headline")


def _read_quoted_articles(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records with line breaks in quotes, which ``spark.read.csv`` reads a file a task."""
    line = F.col("value")
    odd = lambda field: quote_count(field) % 2 == 1
    # Outside, only a quote that begins a field counts; inside, every one ends or begins a quotation.
    step = lambda inside, field: F.when(inside, ~odd(field)).otherwise(F.startswith(field, F.lit('"')) & odd(field))
    walk = lambda begin: F.aggregate(F.split(line, "\t"), F.lit(begin), step)
    quotes = F.contains(line, F.lit('"'))
    records = read_quoted(
        spark, path, "\n",
        outside=F.when(quotes, walk(False)).otherwise(F.lit(False)),
        inside=F.when(quotes, walk(True)).otherwise(F.lit(True)),
    )
    record = F.regexp_replace("value", r"\r\z", "")
    options = {"multiLine": "true", "dateFormat": "yyyy-MM-dd", **TSV_OPTIONS}
    rows = records.select(record.alias("value")).filter("value != ''")
    return rows.select(F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("r")).select("r.*")


def write_articles(
    articles: DataFrame,
    path: str,
    columns: tuple[str, ...] = ("date", "headline", "content_new"),
    fmt: str = "parquet",
    rows_per_file: int = 25_000,
    multi_line: bool = False,
) -> None:
    """Write the named columns as Parquet, or as tab-separated text with ``fmt="tsv"``.

    In text a line break within a field becomes a space, so that every reader can split the files.
    With ``multi_line`` it is kept, and files are kept to ``rows_per_file`` rows, because most
    readers take one such file per task.
    """
    chosen = articles.select(*columns)
    if fmt == "tsv" and not multi_line:
        strings = [f.name for f in chosen.schema.fields if isinstance(f.dataType, T.StringType)]
        chosen = chosen.withColumns({c: F.regexp_replace(c, r"\r\n|\r|\n", " ") for c in strings})
    if fmt == "parquet":
        chosen.write.parquet(path)
    elif fmt == "tsv":
        chosen.write.option("maxRecordsPerFile", rows_per_file if multi_line else 0).csv(
            path,
            dateFormat="yyyy-MM-dd",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            **TSV_OPTIONS,
        )
    else:
        raise ValueError(f"unknown format {fmt!r}: use 'parquet' or 'tsv'")


def with_doc_id(articles: DataFrame) -> DataFrame:
    """Add a ``doc_id``; write the result out before using it twice, as a rescan may renumber."""
    return articles.withColumn("doc_id", F.monotonically_increasing_id())
