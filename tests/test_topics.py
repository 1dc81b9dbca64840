import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from corpusloom.config import (
    TopicParams,
    batch_profile,
    multicore_profile,
    multicore_trial_profile,
    spark_profile,
    spark_trial_profile,
)
from corpusloom.operators.topics import fit_tasks, fit_topics

SETTINGS = TopicParams(topics=3, max_iter=5, vocab_size=50, min_df_frac=0.01, top_words=4)


@pytest.fixture(scope="module")
def docs(spark):
    themes = [["ball", "goal", "team", "match"], ["vote", "law", "party", "seat"], ["film", "song", "stage", "art"]]
    rows = [(i, themes[i % 3] * (1 + i % 4) + ["word"]) for i in range(90)] + [(90, []), (91, ["unseen"] * 0)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4, "doc_id").cache()


@pytest.fixture(scope="module")
def model(docs):
    return fit_topics(docs, SETTINGS)


def test_describe(model):
    rows = model.describe().orderBy("topic", "rank").collect()
    assert len(rows) == 3 * 4 and [r["rank"] for r in rows[:4]] == [1, 2, 3, 4]
    for topic in range(3):
        weights = [r["weight"] for r in rows if r["topic"] == topic]
        assert weights == sorted(weights, reverse=True)


def test_frequencies_hold_the_described_terms(model):
    described = {(r["topic"], r["term"]): r["weight"] for r in model.describe().collect()}
    maps = {r["topic"]: r["frequencies"] for r in model.frequencies().collect()}
    assert {(t, w): x for t, m in maps.items() for w, x in m.items()} == described


def test_mixtures(model, docs):
    rows = {r["doc_id"]: r for r in model.mixtures(docs).collect()}
    assert len(rows) == 92
    for key, row in rows.items():
        shares = row["topicDistribution"]
        if key >= 90:
            assert shares == [0.0] * 3 and row["dominant_topic"] is None
        else:
            assert math.isclose(sum(shares), 1.0, rel_tol=1e-9)
            assert row["dominant_topic"] == shares.index(max(shares))


def test_quality_agrees_with_spark_ml(model, docs):
    row = model.quality(docs).first()
    features = model.features(docs)
    assert math.isclose(row["log_perplexity"], model.model.logPerplexity(features), rel_tol=1e-6)
    assert math.isclose(row["perplexity"], math.exp(row["log_perplexity"]), rel_tol=1e-9)
    assert math.isclose(row["log_likelihood"], model.model.logLikelihood(features), rel_tol=1e-6)


def test_same_seed_same_model(model, docs):
    again = fit_topics(docs, SETTINGS)
    order = ["topic", "rank"]
    assert again.describe().orderBy(*order).collect() == model.describe().orderBy(*order).collect()


def test_weighted_features(docs):
    weighted = fit_topics(docs, replace(SETTINGS, features_col="idf", max_iter=2))
    assert weighted.describe().count() == 12
    assert weighted.mixtures(docs).count() == 92
    assert weighted.quality(docs).first()["perplexity"] > 0


def test_params(model):
    table = {r["param"]: r["value"] for r in model.params().collect()}
    assert table["k"] == "3" and table["seed"] == "1" and table["vocabSize"] == str(model.vocab.count())


def test_priors_of_the_batch_profile(docs):
    settings = batch_profile(topics=4, passes=1)
    trained = fit_topics(docs, settings).model
    assert list(trained.estimatedDocConcentration().toArray()) == [0.25] * 4
    assert trained.getTopicConcentration() == 0.25
    terms = [r["term"] for r in fit_topics(docs, settings).vocab.orderBy("term_id").collect()]
    assert terms == sorted(terms) and "word" not in terms


def test_profiles():
    assert (spark_profile().topics, spark_profile().iterations) == (20, 200)
    assert (spark_trial_profile().topics, spark_trial_profile().vocab_size) == (15, 5_000)
    chunked = multicore_profile()
    assert chunked.iterations == 10 * 5 and math.isclose(chunked.sampling_rate, 1 / 5)
    assert multicore_trial_profile().passes == 20
    assert batch_profile().iterations == 200 * 5 and spark_profile().sampling_rate is None


def test_tasks_of_a_fit_follow_the_documents_alone():
    assert [fit_tasks(n) for n in (0, 1, 5_000, 10**6, 10**9)] == [1, 1, 5, 64, 10_000]


def test_vocabulary_given_from_outside(spark, docs):
    vocab = spark.createDataFrame([(0, "ball", 1, 1), (1, "vote", 1, 1)], "term_id int, term string, df long, cf long")
    trained = fit_topics(docs, replace(SETTINGS, topics=2), vocab=vocab)
    assert trained.model.vocabSize() == 2
    assert {r["term"] for r in trained.describe(5).collect()} == {"ball", "vote"}


def test_dominant_topics_separate_the_themes(docs):
    trained = fit_topics(docs, replace(SETTINGS, max_iter=60))
    best = trained.mixtures(docs).filter("doc_id < 90").withColumn("theme", F.col("doc_id") % 3)
    assert best.groupBy("theme").agg(F.count_distinct("dominant_topic").alias("n")).filter("n > 1").count() == 0


def test_the_best_of_some_fits_is_kept(spark, monkeypatch):
    """The likelihood decides, not the order; all fits share one vocabulary."""
    from corpusloom.operators import topics as O

    docs = spark.createDataFrame([(i, ["a", "b"] if i % 2 else ["c", "d"]) for i in range(40)], "doc_id long, tokens array<string>")
    settings = TopicParams(topics=2, max_iter=2, vocab_size=10, min_df_frac=0.001, max_df_frac=1.0, seed=7, restarts=3)
    figures, seen = {7: -9.0, 8: -3.0, 9: -5.0}, []
    fit = O.fit_topics

    def noted(*args):
        seen.append((args[1].seed, args[4] is not None))
        return fit(*args)

    monkeypatch.setattr(O, "fit_topics", noted)
    figure = lambda model, docs: spark.createDataFrame([(figures[model.settings.seed],)], "log_likelihood double")
    monkeypatch.setattr(O.TopicModel, "quality", figure)
    assert O.fit_best(docs, settings).settings.seed == 8
    assert seen == [(7, False), (8, True), (9, True)]


def test_the_optimizer_keeps_the_vectors_itself(docs, monkeypatch):
    """It does so only for a table that is not cached; a cached one is decoded whole in every step."""
    from corpusloom.operators import topics as O

    levels, made = [], O._lda

    def watched(settings):
        lda = made(settings)
        fit = lda.fit
        monkeypatch.setattr(lda, "fit", lambda rows: levels.append(rows.storageLevel) or fit(rows), raising=False)
        return lda

    monkeypatch.setattr(O, "_lda", watched)
    fit_topics(docs, replace(SETTINGS, max_iter=2))
    assert [(level.useMemory, level.useDisk) for level in levels] == [(False, False)]
