"""Queries over topic models trained on the documents.

Training has no SQL counterpart. Beside each report that depends on it stands a query that returns
its exact properties, such as the documents whose shares sum to one, and has one. The vocabulary of
each profile, the mass of its tokens and its parameters are worked out in SQL.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.config import (
    TopicParams,
    batch_profile,
    multicore_profile,
    spark_profile,
    spark_trial_profile,
)
from corpusloom.functions import tokens as K
from corpusloom.operators.chunked_topics import fit_by_chunks
from corpusloom.operators.matching import match_topics
from corpusloom.operators.topics import TopicModel, fit_topics
from corpusloom.plans.topic_jobs import train_batch, train_multicore, train_spark
from corpusloom.queries import inputs as I
from corpusloom.queries.counts import _bounds, _vocab
from corpusloom.queries.inputs import ALL, with_
from corpusloom.queries.words import _ALPHA, _KEPT_CTE, _LEMMA_CTE
from corpusloom.session import write_scratch

# Each model is trained in full, once per session.
SPARK_JOB = spark_profile()
SPARK_TRIAL = spark_trial_profile()
SPARK_WEIGHTED = spark_trial_profile(features_col="idf")
MULTICORE_JOB = multicore_profile()
BATCH_JOB = batch_profile()

_TRAIN = {SPARK_JOB: train_spark, SPARK_TRIAL: train_spark, SPARK_WEIGHTED: train_spark,
          MULTICORE_JOB: train_multicore, BATCH_JOB: train_batch}


@lru_cache(maxsize=8)
def _trained(spark, sf_dir: str, settings: TopicParams) -> tuple[TopicModel, object]:
    """A model and its prepared documents, trained once per session and profile."""
    return _TRAIN[settings](
        I.documents(spark, sf_dir),
        I.stopwords(spark, sf_dir),
        I.lemma_lookup(spark, sf_dir),
        settings,
        text="text",
    )


def _described(spark, sf_dir, settings):
    topics = _trained(spark, sf_dir, settings)[0].describe()
    return topics.select(
        F.col("topic").cast("bigint"), F.col("rank").cast("bigint"), "term", "weight"
    )


def m1_spark_topics(spark, sf_dir):
    return _described(spark, sf_dir, SPARK_JOB)


def m1_weighted_topics(spark, sf_dir):
    return _described(spark, sf_dir, SPARK_WEIGHTED)


def m2_multicore_topics(spark, sf_dir):
    return _described(spark, sf_dir, MULTICORE_JOB)


def m3_batch_topics(spark, sf_dir):
    return _described(spark, sf_dir, BATCH_JOB)


def m4_doc_topics(spark, sf_dir):
    model, docs = _trained(spark, sf_dir, SPARK_JOB)
    # The outer form keeps Spark from testing the arrays first and scoring every document twice.
    shares = model.mixtures(docs).select(
        "doc_id", "dominant_topic", F.posexplode_outer("topicDistribution").alias("topic", "share")
    )
    return shares.select(
        "doc_id",
        F.col("dominant_topic").cast("bigint"),
        F.col("topic").cast("bigint"),
        "share",
    )


def m4_share_sums(spark, sf_dir):
    """Shares sum to one, or to zero where no term of the vocabulary occurs."""
    model, docs = _trained(spark, sf_dir, SPARK_JOB)
    total = F.aggregate("topicDistribution", F.lit(0.0), lambda acc, share: acc + share)
    return model.mixtures(docs).select(
        "doc_id",
        F.size("topicDistribution").cast("bigint").alias("topics"),
        F.round(total, 6).alias("share_sum"),
        F.col("dominant_topic").isNotNull().alias("has_topic"),
    )


def m5_quality(spark, sf_dir):
    model, docs = _trained(spark, sf_dir, BATCH_JOB)
    return model.quality(docs)


def m6_top_terms(spark, sf_dir):
    return _described(spark, sf_dir, SPARK_TRIAL)


def m6_topic_shape(spark, sf_dir):
    """Every topic has its full number of distinct terms, weights never rising with the rank."""
    topics = _described(spark, sf_dir, SPARK_JOB)
    by_rank = F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "weight"))), lambda row: row["weight"]
    )
    return topics.groupBy("topic").agg(
        F.count_distinct("term").alias("terms"),
        (by_rank == F.sort_array(by_rank, asc=False)).alias("falling"),
    )


def m7_batch_keywords(spark, sf_dir):
    topics = _trained(spark, sf_dir, BATCH_JOB)[0].describe()
    return topics.select(
        F.col("topic").cast("bigint"), F.col("rank").cast("bigint"), "term", "weight"
    )


def m8_model_params(spark, sf_dir):
    return _trained(spark, sf_dir, BATCH_JOB)[0].params()


def m9_topic_frequencies(spark, sf_dir):
    frequencies = _trained(spark, sf_dir, SPARK_JOB)[0].frequencies()
    return frequencies.select(
        F.col("topic").cast("bigint"), F.explode("frequencies").alias("term", "weight")
    )


def _topic_facts(spark, sf_dir, settings):
    """Per topic: the terms of its whole distribution, how many are distinct, that the weights are
    shares which never rise with the rank, and their sum."""
    model = _trained(spark, sf_dir, settings)[0]
    terms = model.describe(model.model.vocabSize())
    by_rank = F.transform(F.sort_array(F.collect_list(F.struct("rank", "weight"))), lambda r: r["weight"])
    weight = F.col("weight")
    return terms.groupBy(F.col("topic").cast("bigint").alias("topic")).agg(
        F.count(F.lit(1)).alias("terms"),
        F.count_distinct("term").alias("distinct_terms"),
        F.round(F.sum("weight"), 6).alias("weight_sum"),
        (F.min((weight > 0) & (weight <= 1)) & (by_rank == F.sort_array(by_rank, asc=False))).alias("falling_shares"),
    )


def m1_topic_facts(spark, sf_dir):
    return _topic_facts(spark, sf_dir, SPARK_JOB)


def m2_topic_facts(spark, sf_dir):
    return _topic_facts(spark, sf_dir, MULTICORE_JOB)


def m3_topic_facts(spark, sf_dir):
    return _topic_facts(spark, sf_dir, BATCH_JOB)


def m5_quality_facts(spark, sf_dir):
    """The token mass behind the quality, and that its three figures agree."""
    model, docs = _trained(spark, sf_dir, SPARK_JOB)
    mass = docs.select(F.inline(K.count_terms("tokens"))).join(F.broadcast(model.vocab.select("term")), "term")
    row = model.quality(docs)
    exact = F.abs(F.col("perplexity") - F.exp("log_perplexity")) <= 1e-9 * F.col("perplexity")
    same = F.abs(F.col("log_likelihood") + F.col("log_perplexity") * F.col("mass")) <= 1e-6 * F.abs("log_likelihood")
    return row.crossJoin(F.broadcast(mass.agg(F.sum("tf").alias("mass")))).select(
        "mass", exact.alias("perplexity_agrees"), same.alias("likelihood_agrees")
    )


def m7_keyword_facts(spark, sf_dir):
    keywords = m7_batch_keywords(spark, sf_dir)
    return keywords.groupBy("topic").agg(F.count(F.lit(1)).alias("keywords"), F.count_distinct("term").alias("distinct_terms"))


_PARAMS = ("k", "maxIter", "optimizer", "seed", "learningOffset", "learningDecay", "subsamplingRate", "vocabSize")


def m8_param_facts(spark, sf_dir):
    params = _trained(spark, sf_dir, SPARK_JOB)[0].params()
    return params.filter(F.col("param").isin(*_PARAMS))


def m9_frequency_facts(spark, sf_dir):
    """Each topic's map has as many terms as its list, with the same weights."""
    model = _trained(spark, sf_dir, SPARK_JOB)[0]
    mapped = model.frequencies().select("topic", F.explode("frequencies").alias("term", "in_map"))
    both = model.describe().join(mapped, ["topic", "term"], "full")
    return both.groupBy(F.col("topic").cast("bigint").alias("topic")).agg(
        F.count(F.lit(1)).alias("terms"), F.coalesce(F.min(F.col("weight") == F.col("in_map")), F.lit(False)).alias("same")
    )


_THEMES, _THEME_WORDS = 3, 12


def _planted(spark, sf_dir):
    """``(doc_id, theme, text)``: forty words from one of three separate groups, told by the key."""
    number = F.pmod(F.col("doc_id"), F.lit(_THEMES))
    letter = lambda i: F.char(F.lit(97) + i)
    word = lambda i: F.concat(F.lit("theme"), letter(number), F.lit("word"), letter(F.pmod(F.xxhash64("doc_id", i), F.lit(_THEME_WORDS))))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), word), " ")
    return write_scratch(
        I.table(spark, sf_dir, "documents").select("doc_id", number.alias("theme"), text.alias("text")), "planted"
    )


def _recovered(spark, sf_dir, train, settings):
    """For each planted theme how many of its words are the first ones of the topic matched to it,
    and how many of its documents have that topic as their main one. Themes are matched one to one,
    so a model with fewer real topics than themes cannot give every theme its own. The best of three
    fits is taken, as a single one may merge two themes."""
    docs = _planted(spark, sf_dir)
    no_lemmas = spark.createDataFrame([], "form string, lemma string")
    model, prepared = train(docs, [], no_lemmas, replace(settings, topics=_THEMES, top_words=_THEME_WORDS, restarts=3), text="text")
    words = docs.select(F.col("theme").alias("topic"), F.explode(F.split("text", " ")).alias("term"))
    matched = match_topics(words, model.describe())
    main = model.mixtures(prepared).join(docs.select("doc_id", F.col("theme").alias("left")), "doc_id")
    joined = main.join(F.broadcast(matched), "left")
    return joined.groupBy(F.col("left").alias("theme"), F.col("common").alias("words")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("dominant_topic") == F.col("right")).alias("recovered")
    )


def m1_recovered_topics(spark, sf_dir):
    return _recovered(spark, sf_dir, train_spark, replace(SPARK_JOB, max_iter=60))


def m2_recovered_topics(spark, sf_dir):
    return _recovered(spark, sf_dir, train_multicore, MULTICORE_JOB)


def m3_recovered_topics(spark, sf_dir):
    return _recovered(spark, sf_dir, train_batch, replace(BATCH_JOB, passes=12))


@lru_cache(maxsize=2)
def _chunked(spark, sf_dir: str, settings: TopicParams):
    docs = _planted(spark, sf_dir).withColumn("tokens", F.split("text", " "))
    return fit_by_chunks(docs, settings), docs


def _by_chunks(spark, sf_dir, settings):
    model, docs = _chunked(spark, sf_dir, replace(settings, topics=_THEMES, top_words=_THEME_WORDS, **_ALL_TERMS))
    words = docs.select(F.col("theme").alias("topic"), F.explode("tokens").alias("term"))
    matched = match_topics(words, model.describe())
    main = model.mixtures(docs).join(docs.select("doc_id", F.col("theme").alias("left")), "doc_id")
    return main.join(F.broadcast(matched), "left").groupBy(F.col("left").alias("theme"), F.col("common").alias("words")).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("dominant_topic") == F.col("right")).alias("recovered")
    )


_ALL_TERMS = dict(min_df_frac=0.001, max_df_frac=1.0, min_df_count=None, vocab_size=1000)


def m2_chunked_topics(spark, sf_dir):
    """The multicore profile trained in passes that meet every document once, on planted themes."""
    return _by_chunks(spark, sf_dir, replace(MULTICORE_JOB, passes=5))


def m2_chunk_visits(spark, sf_dir):
    """How often a pass meets each document."""
    settings = replace(MULTICORE_JOB, passes=5, topics=_THEMES, top_words=_THEME_WORDS, **_ALL_TERMS)
    chunks = _chunked(spark, sf_dir, settings)[0].chunks
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("visits"))


def m10_prepared_documents(spark, sf_dir):
    """The prepared documents that a model is trained on are written once and read again."""
    docs = _trained(spark, sf_dir, SPARK_TRIAL)[1]
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


def m_planted_topics(spark, sf_dir):
    """Documents whose words come from one of three separate groups share their dominant topic with
    their group and with no other: as many topics are dominant as there are groups."""
    docs = _planted(spark, sf_dir).withColumn("tokens", F.split("text", " "))
    model = fit_topics(docs, TopicParams(topics=_THEMES, max_iter=60, vocab_size=100, min_df_frac=0.001, max_df_frac=1.0))
    best = model.mixtures(docs).join(docs.select("doc_id", "theme"), "doc_id")
    share = write_scratch(best.groupBy("theme", "dominant_topic").agg(F.count(F.lit(1)).alias("n")), "shares")
    return share.groupBy("theme").agg(
        F.count(F.lit(1)).alias("topics"), F.sum("n").alias("documents"),
    ).withColumn("all_topics", share.agg(F.count_distinct("dominant_topic").alias("n")).scalar())


QUERIES = {
    q.__name__: q
    for q in (
        m1_spark_topics, m1_weighted_topics, m2_multicore_topics, m3_batch_topics, m4_doc_topics,
        m4_share_sums, m5_quality, m6_top_terms, m6_topic_shape, m7_batch_keywords, m8_model_params,
        m9_topic_frequencies, m1_topic_facts, m2_topic_facts, m3_topic_facts, m5_quality_facts,
        m7_keyword_facts, m8_param_facts, m9_frequency_facts, m1_recovered_topics, m2_recovered_topics,
        m3_recovered_topics, m2_chunked_topics, m2_chunk_visits, m10_prepared_documents, m_planted_topics,
    )
}

_MODEL_VOCAB = with_(
    *ALL,
    _KEPT_CTE,
    _LEMMA_CTE,
    "lemma_stats AS (SELECT lemma AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM lem GROUP BY lemma)",
    _vocab("cf DESC, term", _bounds(0.02, 0.8), 10_000, "lemma_stats"),
)

_LEMMA_STATS = "lemma_stats AS (SELECT lemma AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM lem GROUP BY lemma)"

# Alphabetic parts of hyphenated tokens, then stopwords, then lemmas; a dictionary by documents.
_MULTICORE_VOCAB = with_(
    *ALL,
    "pieces AS (SELECT doc_id, unnest(string_split(token, '-')) AS token FROM tok)",
    f"kept AS (SELECT * FROM pieces WHERE regexp_matches(token, {_ALPHA}) AND token NOT IN (SELECT lower(word) FROM stop))",
    "lem AS (SELECT doc_id, coalesce(lemma, token) AS lemma FROM kept LEFT JOIN lemmas ON form = token)",
    _LEMMA_STATS,
    _vocab("df DESC, term", _bounds(None, 0.8), 100_000, "lemma_stats"),
)

# Lemmas without titles and marks, joined and cut again into words of two characters or more.
_BATCH_VOCAB = with_(
    *ALL,
    _KEPT_CTE,
    _LEMMA_CTE,
    f"removed(word) AS (VALUES {I.words_values((*C.PUNCTUATION, *C.EXTRA_WORDS))})",
    "joined AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY pos) AS l FROM lem "
    "WHERE lower(lemma) NOT IN (SELECT word FROM removed) GROUP BY doc_id)",
    r"again AS (SELECT doc_id, unnest(regexp_extract_all(lower(l), '[\p{L}\p{N}_]{2,}')) AS lemma FROM joined)",
    "lemma_stats AS (SELECT lemma AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM again GROUP BY lemma)",
    _vocab("term", _bounds(0.02, 0.5), None, "lemma_stats"),
)


def _facts(vocab: str, topics: int) -> str:
    return vocab + (
        "SELECT topic, n AS terms, n AS distinct_terms, 1.0::DOUBLE AS weight_sum, true AS falling_shares "
        f"FROM range({topics}) t(topic), (SELECT count(*) AS n FROM vocab)"
    )


_RECOVERED = (
    f"SELECT doc_id % {_THEMES} AS theme, {_THEME_WORDS}::BIGINT AS words, count(*) AS documents, count(*) AS recovered "
    "FROM documents GROUP BY 1"
)

ORACLES = {
    "m1_topic_facts": _facts(_MODEL_VOCAB, 20),
    "m2_topic_facts": _facts(_MULTICORE_VOCAB, 20),
    "m3_topic_facts": _facts(_BATCH_VOCAB, 10),
    "m5_quality_facts": _MODEL_VOCAB
    + "SELECT CAST(sum(cf) AS BIGINT) AS mass, true AS perplexity_agrees, true AS likelihood_agrees FROM vocab",
    "m7_keyword_facts": _BATCH_VOCAB
    + "SELECT topic, least(15, n) AS keywords, least(15, n) AS distinct_terms "
    "FROM range(10) t(topic), (SELECT count(*) AS n FROM vocab)",
    "m8_param_facts": _MODEL_VOCAB
    + "SELECT * FROM (VALUES ('k', '20'), ('maxIter', '200'), ('optimizer', 'online'), ('seed', '1'), "
    "('learningOffset', '100.0'), ('learningDecay', '0.51'), ('subsamplingRate', '0.05')) v(param, value) "
    "UNION ALL SELECT 'vocabSize', CAST(count(*) AS VARCHAR) FROM vocab",
    "m9_frequency_facts": _MODEL_VOCAB
    + "SELECT topic, least(20, n) AS terms, true AS same FROM range(20) t(topic), (SELECT count(*) AS n FROM vocab)",
    "m1_recovered_topics": _RECOVERED,
    "m2_recovered_topics": _RECOVERED,
    "m3_recovered_topics": _RECOVERED,
    "m2_chunked_topics": _RECOVERED,
    "m2_chunk_visits": "SELECT doc_id, count(*) AS visits FROM documents GROUP BY doc_id",
    "m10_prepared_documents": with_(*ALL, _KEPT_CTE, _LEMMA_CTE)
    + "SELECT doc_id, count(lemma) AS n_tokens FROM documents LEFT JOIN lem USING (doc_id) GROUP BY doc_id",
    "m_planted_topics": f"SELECT doc_id % {_THEMES} AS theme, 1::BIGINT AS topics, count(*) AS documents, "
    f"{_THEMES}::BIGINT AS all_topics FROM documents GROUP BY 1",
    "m4_share_sums": _MODEL_VOCAB[:-1]
    + ", known AS (SELECT DISTINCT doc_id FROM lem WHERE lemma IN (SELECT term FROM vocab)) "
    "SELECT d.doc_id, CAST(20 AS BIGINT) AS topics, "
    "CASE WHEN k.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS share_sum, "
    "k.doc_id IS NOT NULL AS has_topic FROM documents d LEFT JOIN known k USING (doc_id)",
    "m6_topic_shape": _MODEL_VOCAB
    + "SELECT topic, least(20, (SELECT count(*) FROM vocab)) AS terms, true AS falling "
    "FROM range(20) t(topic)",
}
