"""Cleaning articles as they arrive.

Cleaning, tokenizing, stopword removal and lookup in an inline dictionary are narrow, so the same
operators apply to a streaming DataFrame; there is no state and no watermark to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.clean import clean_articles
from corpusloom.operators.tokens import tokenize
from corpusloom.sources.articles import TSV_OPTIONS, ARTICLE_SCHEMA


def read_article_stream(
    spark: SparkSession, path: str, files_per_batch: int = 1000, multi_line: bool = False
) -> DataFrame:
    """Tab-separated article files as they appear in a folder; see ``read_articles``."""
    return (
        spark.readStream.schema(ARTICLE_SCHEMA)
        .options(multiLine=multi_line, dateFormat="yyyy-MM-dd", maxFilesPerTrigger=files_per_batch, **TSV_OPTIONS)
        .csv(path)
    )


def clean_stream(articles: DataFrame) -> DataFrame:
    """Cleaned articles with their tokens in ``words``."""
    return tokenize(clean_articles(articles), "content_new")
