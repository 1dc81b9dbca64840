"""From a raw text dump to the cleaned article table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.clean import clean_articles, describe_urls
from corpusloom.sources.articles import write_articles
from corpusloom.sources.dump import segment_articles


def article_table(spark: SparkSession, path: str, keep_last: bool = True) -> DataFrame:
    """``(date, news_category, headline, content, url)`` of every article in the dump."""
    articles = describe_urls(segment_articles(spark, path, keep_last))
    return articles.select("date", "news_category", "headline", "content", "url")


def build_articles(spark: SparkSession, dump: str, target: str, fmt: str = "parquet") -> None:
    """Segment, describe, clean and write a dump in a single pass over the text."""
    cleaned = clean_articles(article_table(spark, dump))
    write_articles(cleaned, target, fmt=fmt)
