"""One-to-one matching of topics against all permutations."""

import random
from itertools import permutations

import pytest

from corpusloom.operators.matching import _assignment, match_topics


@pytest.mark.parametrize("seed", range(40))
def test_best_assignment(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 6)
    gain = [[rng.choice([0, 0, 1, rng.randrange(20)]) for _ in range(n)] for _ in range(n)]
    chosen = _assignment(gain)
    assert sorted(chosen) == list(range(n))
    best = max(sum(gain[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    assert sum(gain[i][chosen[i]] for i in range(n)) == best


def topics(spark, held):
    rows = [(t, w) for t, words in held.items() for w in words]
    return spark.createDataFrame(rows, "topic long, term string")


def test_topics_are_matched_one_to_one(spark):
    left = topics(spark, {0: "abcd", 1: "efgh", 2: "ijkl"})
    right = topics(spark, {0: "ijkx", 1: "abef", 2: "efgy", 7: "zzzz"})
    found = {r["left"]: (r["right"], r["common"]) for r in match_topics(left, right).collect()}
    assert found == {0: (1, 2), 1: (2, 3), 2: (0, 3)}


def test_a_collapsed_model_leaves_topics_unmatched(spark):
    left = topics(spark, {0: "abc", 1: "def", 2: "ghi"})
    collapsed = topics(spark, {0: "adg", 1: "adg", 2: "adg"})
    assert sum(r["common"] for r in match_topics(left, collapsed).collect()) == 3
    fewer = match_topics(left, topics(spark, {5: "abcdef"})).collect()
    assert sorted(r["right"] is None for r in fewer) == [False, True, True]
    assert match_topics(left.limit(0), left).count() == 0
