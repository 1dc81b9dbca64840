"""Corpus profile: sizes, date range, category counts, first and last documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_profile(articles: DataFrame, category: str = "news_category", date: str = "date") -> DataFrame:
    """One row: number of articles and categories, first and last date."""
    return articles.agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_distinct(category).alias("categories"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def value_counts(
    rows: DataFrame, column: str, top: int | None = None, ascending: bool = False
) -> DataFrame:
    """``(column, n)``, most frequent first; ``top`` keeps the largest and ``ascending`` re-sorts."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if top is not None:
        counts = counts.orderBy(F.desc("n"), column).limit(top)
    return counts.orderBy("n" if ascending else F.desc("n"), column)


def first_rows(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return rows.orderBy(key).limit(n)


def last_rows(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    return rows.orderBy(F.desc(key)).limit(n)
