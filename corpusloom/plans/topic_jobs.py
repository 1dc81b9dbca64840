"""Topic jobs from an article table to described topics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from corpusloom.config import TopicParams, batch_profile, multicore_profile, spark_profile
from corpusloom.functions import tokens as K
from corpusloom.operators import tokens as T
from corpusloom.operators.topics import TopicModel, fit_best
from corpusloom.session import write_scratch

Words = DataFrame | Iterable[str]


def _fitted(docs: DataFrame, settings: TopicParams) -> tuple[TopicModel, DataFrame]:
    """The model and the documents it was trained on, whose preparation is written out once."""
    kept = [c for c in docs.columns if c not in ("content", "text")]
    prepared = write_scratch(docs.select(*kept), "prepared")
    return fit_best(prepared, settings), prepared


def train_spark(
    articles: DataFrame,
    words: Words,
    lemmas: DataFrame,
    settings: TopicParams | None = None,
    text: str = "content",
) -> tuple[TopicModel, DataFrame]:
    """The distributed job: every token kind, vocabulary by corpus frequency."""
    docs = T.preprocess(articles, words, lemmas, text)
    return _fitted(docs, settings or spark_profile())


def train_multicore(
    articles: DataFrame,
    words: Words,
    lemmas: DataFrame,
    settings: TopicParams | None = None,
    text: str = "content",
) -> tuple[TopicModel, DataFrame]:
    """Alphabetic tokens only, dictionary by document frequency, several passes in chunks."""
    docs = T.preprocess(articles, words, lemmas, text, alpha_only=True, break_hyphens=True)
    return _fitted(docs, settings or multicore_profile())


def train_batch(
    articles: DataFrame,
    words: Words,
    lemmas: DataFrame,
    settings: TopicParams | None = None,
    text: str = "content",
) -> tuple[TopicModel, DataFrame]:
    """Titles and punctuation removed, words of two or more characters, alphabetical vocabulary."""
    docs = T.remove_words(T.preprocess(articles, words, lemmas, text))
    docs = T.join_tokens(docs, "tokens", "joined")
    docs = docs.withColumn("tokens", K.tokenize("joined", K.WORD_PATTERN)).drop("joined")
    return _fitted(docs, settings or batch_profile())
