import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.clustering import LDA
from pyspark.ml.linalg import Vectors

from corpusloom.config import batch_profile, spark_trial_profile
from corpusloom.operators import online_topics as O
from corpusloom.operators.topics import _lda


@pytest.fixture(scope="module")
def vectors(spark):
    """Short, long, repeated and empty documents, one with a stored zero, in three tasks."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        ids = sorted(rng.choice(60, int(rng.integers(1, 40)), replace=False).tolist())
        rows.append((i, Vectors.sparse(60, ids, rng.integers(1, 6, len(ids)).astype(float).tolist())))
    rows += [(200, Vectors.sparse(60, [], [])), (201, rows[3][1]), (202, rows[3][1]), (203, Vectors.sparse(60, [1, 7], [0.0, 2.0]))]
    rows += [(204, Vectors.sparse(60, [2, 3], [0.0, 0.0])), (205, Vectors.dense([1.0, 0.0] * 30))]
    return spark.createDataFrame(rows, ["doc_id", "features"]).repartition(3, "doc_id").sortWithinPartitions("doc_id")


def _both(vectors, **given):
    return LDA(optimizer="online", **given).fit(vectors), O.BatchedLDA(optimizer="online", **given).fit(vectors)


@pytest.mark.parametrize("rate", [0.05, 0.3, 1.0])
@pytest.mark.parametrize("own_priors", [False, True])
def test_the_fit_is_that_of_spark(vectors, rate, own_priors):
    given = dict(k=4, maxIter=12, seed=3, subsamplingRate=rate, learningOffset=1.0, learningDecay=0.6, optimizeDocConcentration=own_priors)
    was, now = _both(vectors, **given)
    assert np.allclose(now.topicsMatrix().toArray(), was.topicsMatrix().toArray(), rtol=1e-9)
    assert np.allclose(now.estimatedDocConcentration().toArray(), was.estimatedDocConcentration().toArray(), rtol=1e-9)
    named = lambda model: {p.name: value for p, value in model.extractParamMap().items()}
    assert named(now) == named(was)
    assert math.isclose(now.logLikelihood(vectors), was.logLikelihood(vectors), rel_tol=1e-9)
    assert [list(r) for r in now.describeTopics(5).select("topic", "termIndices").collect()] == [
        list(r) for r in was.describeTopics(5).select("topic", "termIndices").collect()
    ]


def test_sums_of_large_vocabularies_are_shuffled_by_blocks(vectors, monkeypatch):
    given = dict(k=3, maxIter=6, seed=8, subsamplingRate=0.4)
    direct = O.BatchedLDA(**given).fit(vectors).topicsMatrix().toArray()
    monkeypatch.setattr(O, "DIRECT_BYTES", 0)
    monkeypatch.setattr(O, "BLOCK", 16)
    assert np.allclose(O.BatchedLDA(**given).fit(vectors).topicsMatrix().toArray(), direct, rtol=1e-12)


def test_tasks_inferred_together_give_the_same_fit(vectors, monkeypatch):
    given = dict(k=3, maxIter=6, seed=8, subsamplingRate=0.4)
    one = O.BatchedLDA(**given).fit(vectors).topicsMatrix().toArray()
    monkeypatch.setattr(O, "LEAST_PER_TASK", 1)
    assert np.allclose(O.BatchedLDA(**given).fit(vectors).topicsMatrix().toArray(), one, rtol=1e-12)


def test_documents_without_a_term(spark):
    empty = spark.createDataFrame([(i, Vectors.sparse(5, [], [])) for i in range(6)], ["doc_id", "features"])
    was, now = _both(empty, k=2, maxIter=3, seed=1, subsamplingRate=0.5)
    assert np.allclose(now.topicsMatrix().toArray(), was.topicsMatrix().toArray(), rtol=1e-12)


def test_random_numbers_are_those_of_the_jvm(spark):
    jvm = spark.sparkContext._jvm
    theirs, ours = jvm.java.util.Random(-77), O._java_longs(-77)
    assert [theirs.nextLong() for _ in range(50)] == [next(ours) for _ in range(50)]
    seed = -4567890123456789
    twister = jvm.org.apache.commons.math3.random.MersenneTwister(seed)
    gamma = jvm.breeze.stats.distributions.Gamma(100.0, 0.01, jvm.breeze.stats.distributions.RandBasis(twister))
    _, draws, _ = O._numerics()
    assert np.allclose([gamma.draw() for _ in range(3001)], draws(seed % 2**64, 3001), rtol=1e-12)


def test_digamma_is_that_of_the_jvm(spark):
    digamma = spark.sparkContext._jvm.org.apache.commons.math3.special.Gamma.digamma
    x = np.concatenate([np.geomspace(1e-4, 1e5, 200), np.arange(1, 60)])
    psi, _, _ = O._numerics()
    assert np.allclose(psi(x), [digamma(float(v)) for v in x], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("profile", [batch_profile, spark_trial_profile])
def test_a_step_draws_and_infers_in_one_job(spark, vectors, profile):
    """Spark's optimizer has two jobs and three stages a step, and infers one document after another."""
    settings = replace(profile(), topics=2, max_iter=4, passes=None)
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    counts = []
    for steps in (4, 14):
        sc.setJobGroup(f"steps-{profile.__name__}-{steps}", "")
        _lda(settings).setMaxIter(steps).fit(vectors)
        counts.append(len(tracker.getJobIdsForGroup(f"steps-{profile.__name__}-{steps}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] - counts[0] == 10
