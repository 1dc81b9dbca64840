"""Passes over chunks: every document once, planted themes recovered, figures by definition."""

from math import lgamma

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.config import TopicParams
from corpusloom.operators import chunked_topics as O
from corpusloom.operators.matching import match_topics

SETTINGS = TopicParams(
    topics=3, passes=6, steps_per_pass=4, vocab_size=100, min_df_frac=0.001, max_df_frac=1.0,
    learning_offset=1.0, learning_decay=0.5, top_words=8,
)


@pytest.fixture(scope="module")
def planted(spark):
    word = lambda i: F.concat(F.lit("t"), F.col("doc_id") % 3, F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(8)))
    docs = spark.range(240).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("theme"))
    return docs.withColumn("tokens", F.transform(F.sequence(F.lit(1), F.lit(30)), word))


def test_digamma():
    digamma, _ = O._inference()
    for x in (0.01, 0.3, 1.0, 5.9, 6.0, 50.0):
        assert abs(digamma(np.array([x]))[0] - (lgamma(x + 1e-5) - lgamma(x - 1e-5)) / 2e-5) < 1e-4 * max(1, 1 / x)
    assert abs(digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-10


def test_every_document_is_in_one_chunk_and_themes_are_recovered(spark, planted):
    model = O.fit_by_chunks(planted, SETTINGS)
    chunks = model.chunks.groupBy("doc_id").count().collect()
    assert len(chunks) == 240 and {r["count"] for r in chunks} == {1}
    assert {r["chunk"] for r in model.chunks.select("chunk").distinct().collect()} == {0, 1, 2, 3}
    words = planted.select(F.col("theme").alias("topic"), F.explode("tokens").alias("term"))
    matched = {r["left"]: (r["right"], r["common"]) for r in match_topics(words, model.describe()).collect()}
    assert [n for _, n in matched.values()] == [8, 8, 8]
    for r in model.mixtures(planted).join(planted.select("doc_id", "theme"), "doc_id").collect():
        assert r["dominant_topic"] == matched[r["theme"]][0] and abs(sum(r["topicDistribution"]) - 1) < 1e-9
    again = O.fit_by_chunks(planted.repartition(5), SETTINGS)
    assert np.allclose(again.weights, model.weights, rtol=1e-6)


def test_likelihood_tells_a_fit_from_none(spark, planted):
    fitted = O.fit_by_chunks(planted, SETTINGS)
    flat = O.ChunkedModel(np.ones_like(fitted.weights), fitted.vocab, SETTINGS, 0, fitted.chunks)
    good, bad = (m.quality(planted).first() for m in (fitted, flat))
    assert good["log_likelihood"] > bad["log_likelihood"] and good["perplexity"] < bad["perplexity"]
    assert 7 < good["perplexity"] < 14  # eight words a theme, evenly


def test_a_step_equals_the_plain_sum(spark, planted, monkeypatch):
    """The distributed sums of a chunk against one loop over its documents."""
    monkeypatch.setattr(O, "BLOCK", 5)
    model = O.fit_by_chunks(planted, SETTINGS, passes=1)
    lists = O.term_lists(planted, model.vocab, "doc_id").withColumn("part", F.col("doc_id").cast("int") % 7)
    _, infer = O._inference()
    want = np.zeros_like(model.weights)
    for r in lists.collect():
        _, theta, ratio = infer(model._beta, 1 / 3, np.array(r["ids"]), np.array(r["counts"]))
        want[:, r["ids"]] += np.outer(theta, ratio)
    got = O._summed(lists.repartition(7, "part"), spark.sparkContext.broadcast(model._beta), *want.shape, SETTINGS)
    assert np.allclose(got, want) and abs((got * model._beta).sum() - 240 * 30) < 1e-6


def test_awkward_documents(spark, planted):
    odd = spark.createDataFrame([(None, ["t0w1"]), (7, None), (7, []), (8, ["unheard"])], "doc_id long, tokens array<string>")
    docs = planted.select("doc_id", "tokens").unionByName(odd)
    model = O.fit_by_chunks(docs, SETTINGS, passes=1)
    shares = model.mixtures(odd).collect()
    assert sorted(r["dominant_topic"] is None for r in shares) == [False, False, True, True]
    assert model.quality(odd.filter("doc_id = 7")).first()["perplexity"] is None


def test_documents_inferred_together_have_the_results_of_each_alone():
    """Each document ends by itself; against one plain loop a document."""
    digamma, infer_all, blocks = O._together()
    rng = np.random.default_rng(3)
    beta, alpha = rng.gamma(1.0, 1.0, (4, 50)) / 50, 0.25
    lengths = rng.integers(0, 30, 200)
    lists = [rng.choice(50, n, replace=False) for n in lengths]
    frame = pd.DataFrame({"ids": lists, "counts": [rng.integers(1, 9, n).astype(float) for n in lengths]})
    done = []
    for rows, ids, counts, sizes in blocks(frame, 2000):
        gamma, theta, norm = infer_all(beta, alpha, ids, counts, sizes)
        ends = np.cumsum(sizes)
        for i, (row, end, n) in enumerate(zip(rows, ends, sizes)):
            own, c, g = beta[:, lists[row]], frame["counts"][row], np.ones(4)
            t = np.exp(digamma(g) - digamma(g.sum()))
            for _ in range(O.ROUNDS):
                before, g = g, alpha + t * (own @ (c / (t @ own + 1e-100)))
                t = np.exp(digamma(g) - digamma(g.sum()))
                if np.abs(g - before).mean() < O.CLOSE:
                    break
            assert np.allclose(gamma[:, i], g) and np.allclose(theta[:, i], t) and np.allclose(norm[end - n : end], t @ own)
            done.append(row)
    assert done == list(np.flatnonzero(lengths))
