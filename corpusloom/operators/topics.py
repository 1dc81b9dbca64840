"""Latent Dirichlet allocation: training, document mixtures, quality, topic words."""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import ceil

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import IDF, CountVectorizerModel, IDFModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import TopicParams
from corpusloom.operators import vocab as V
from corpusloom.operators.lookups import name_terms
from corpusloom.operators.online_topics import BatchedLDA
from corpusloom.session import write_scratch

# Vectors are far smaller than texts, and every task of a training step returns one matrix of
# topics by terms, so tasks are sized by vectors and not taken over from the text scan. How many
# there are depends on the number of documents alone: a fit is the same on every cluster.
VECTORS_PER_TASK = 100_000
SMALL_TASK, SMALL_TASKS = 1_000, 64


@dataclass
class TopicModel:
    """A fitted model with its vocabulary; every report is a DataFrame."""

    model: LDAModel
    vocab: DataFrame
    vectorizer: CountVectorizerModel
    settings: TopicParams
    idf: IDFModel | None = None

    def features(self, docs: DataFrame) -> DataFrame:
        """Add the vectors the model was trained on."""
        counted = self.vectorizer.transform(docs)
        return self.idf.transform(counted) if self.idf else counted

    def mixtures(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        """``(key, topicDistribution, dominant_topic)``.

        Shares sum to 1. A document without known terms has shares of 0 and no dominant topic.
        """
        scored = self.model.transform(self.features(docs))
        shares = scored.select(key, vector_to_array("topicDistribution").alias("topicDistribution"))
        best = F.array_max("topicDistribution")
        return shares.withColumn(
            "dominant_topic",
            F.when(best > 0, F.array_position("topicDistribution", best).cast("int") - 1),
        )

    def quality(self, docs: DataFrame) -> DataFrame:
        """One row: log likelihood, log perplexity and perplexity.

        The log perplexity is the negated log likelihood per token. ``docs`` is read twice, for
        the tokens and for the likelihood; hand over prepared documents. Without a known term all
        three are null.
        """
        features = self.features(docs)
        column = self.settings.features_col
        mass = features.select(Summarizer.sum(F.col(column)).alias("mass")).first()["mass"]
        tokens = float(mass.toArray().sum()) if mass is not None else 0.0
        likelihood = self.model.logLikelihood(features) if tokens else None
        per_token = -likelihood / tokens if tokens else None
        return docs.sparkSession.range(1).select(
            F.lit(likelihood).cast("double").alias("log_likelihood"),
            F.lit(per_token).cast("double").alias("log_perplexity"),
            F.exp(F.lit(per_token).cast("double")).alias("perplexity"),
        )

    def describe(self, n: int | None = None) -> DataFrame:
        """``(topic, rank, term, weight)``: the ``n`` heaviest terms of each topic."""
        top = self.model.describeTopics(n or self.settings.top_words)
        pairs = F.arrays_zip("termIndices", "termWeights")
        rows = top.select("topic", F.posexplode(pairs).alias("rank", "pair")).select(
            "topic",
            (F.col("rank") + 1).alias("rank"),
            F.col("pair.termIndices").alias("term_id"),
            F.col("pair.termWeights").alias("weight"),
        )
        return name_terms(rows, self.vocab).select("topic", "rank", "term", "weight")

    def frequencies(self, n: int | None = None) -> DataFrame:
        """``(topic, frequencies)`` with a map from term to weight, at most ``n`` terms each."""
        pairs = F.sort_array(F.collect_list(F.struct("rank", "term", "weight")))
        entries = F.transform(pairs, lambda p: F.struct(p["term"], p["weight"]))
        return self.describe(n).groupBy("topic").agg(F.map_from_entries(entries).alias("frequencies"))

    def params(self) -> DataFrame:
        """``(param, value)`` of everything the model was trained with."""
        rows = [(p.name, str(value)) for p, value in self.model.extractParamMap().items()]
        rows.append(("vocabSize", str(self.model.vocabSize())))
        return self.vocab.sparkSession.createDataFrame(sorted(rows), "param string, value string")


def fit_topics(
    docs: DataFrame,
    settings: TopicParams,
    tokens: str = "tokens",
    key: str = "doc_id",
    vocab: DataFrame | None = None,
) -> TopicModel:
    """Train a topic model on ``(key, tokens)``.

    ``docs`` is read for the vocabulary and for the vectors; the jobs of ``plans`` write it out
    first. Only the vectors are shuffled and kept: hashing and sorting them by document key
    balances the tasks and makes the fit repeatable.
    """
    kept = docs.select(key, tokens)
    n_docs = kept.count()
    if vocab is None:
        vocab = V.build_vocab(
            kept,
            min_df_frac=settings.min_df_frac,
            max_df_frac=settings.max_df_frac,
            min_df_count=settings.min_df_count,
            size=settings.vocab_size,
            order=settings.vocab_order,
            tokens=tokens,
            n_docs=n_docs,
        )
    vocab = write_scratch(vocab, "vocabulary")
    vectorizer = V.vectorizer(V.terms_in_order(vocab), tokens)
    features = vectorizer.transform(kept)
    idf = None
    if settings.features_col == "idf":
        idf = IDF(inputCol="features", outputCol="idf").fit(features)
        features = idf.transform(features)
    features = (
        features.select(key, settings.features_col)
        .repartition(fit_tasks(n_docs), key)
        .sortWithinPartitions(key)
    )
    # The optimizer keeps the vectors itself, as objects. It would not do so with a cached table, which
    # is decoded whole in every step, also where a step draws one document in twenty.
    model = _lda(settings).fit(features)
    return TopicModel(model, vocab, vectorizer, settings, idf)


def fit_best(docs: DataFrame, settings: TopicParams, tokens: str = "tokens", key: str = "doc_id") -> TopicModel:
    """The fit of the highest log likelihood among ``settings.restarts`` ones.

    A single fit may end with two themes in one topic, and another theme in two. ``docs`` is read again
    for every fit; hand over prepared documents. All fits share one vocabulary.
    """
    best, most, vocab = None, None, None
    for restart in range(max(1, settings.restarts)):
        own = replace(settings, seed=settings.seed + restart)
        model = fit_topics(docs, own, tokens, key, vocab)
        if settings.restarts <= 1:
            return model
        vocab = model.vocab
        likelihood = model.quality(docs).first()["log_likelihood"]
        if best is None or (likelihood is not None and (most is None or likelihood > most)):
            best, most = model, likelihood
    return best


def fit_tasks(n_docs: int) -> int:
    """The number of tasks a training step has."""
    return max(1, min(SMALL_TASKS, ceil(n_docs / SMALL_TASK)), ceil(n_docs / VECTORS_PER_TASK))


def _lda(settings: TopicParams) -> LDA:
    lda = BatchedLDA(
        k=settings.topics,
        maxIter=settings.iterations,
        optimizer="online",
        seed=settings.seed,
        learningOffset=settings.learning_offset,
        learningDecay=settings.learning_decay,
        featuresCol=settings.features_col,
    )
    rate = settings.sampling_rate
    if rate is not None:
        lda = lda.setSubsamplingRate(rate)
    if settings.symmetric_priors:
        prior = 1.0 / settings.topics
        lda = (
            lda.setDocConcentration([prior])
            .setTopicConcentration(prior)
            .setOptimizeDocConcentration(False)
        )
    return lda
