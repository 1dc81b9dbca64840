"""From segmented articles to the cleaned article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def describe_urls(articles: DataFrame) -> DataFrame:
    """Add date, news category and headline, all taken from the URL."""
    return articles.withColumns(
        {"date": X.url_date("url"), "news_category": X.news_category("url"), "headline": X.headline("url")}
    )


def keep_english(articles: DataFrame) -> DataFrame:
    """Keep and mark articles without Hangul, kana or Han characters."""
    # Marked after the filter, where it is known, so that the text is searched once.
    return articles.filter(X.has_no_cjk("content")).withColumn("is_english", F.lit(True))


def clean_articles(articles: DataFrame) -> DataFrame:
    """The whole cleaning chain as one narrow stage; articles left empty are dropped.

    A filter on the cleaned text would be pushed below the projection and clean every text twice.
    Exploding a list that is empty for an empty text keeps it to once.
    """
    cleaned = F.filter(F.array(X.clean_text("content")), lambda text: text != "")
    return keep_english(articles).withColumn("content_new", F.explode(cleaned))


def explode_sentences(articles: DataFrame, text: str = "content", key: str = "doc_id") -> DataFrame:
    """One row per sentence: ``(key, pos, sentence)``."""
    return articles.select(key, F.posexplode(X.sentences(text)).alias("pos", "sentence"))
