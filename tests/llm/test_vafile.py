"""Top-k search against all pairs in exact integers."""

import math
import random

from pyspark.sql import functions as F

from corpusloom.llm import vafile


def brute(rows, k, asks):
    usable = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and usable(v)}
    out = set()
    for q, a in whole:
        if asks(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def found(df, params=vafile.VaParams()):
    rows = vafile.top_k(df, F.col("vec_id") % 5 == 0, params).collect()
    out = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows}
    assert len(out) == len(rows)
    return out


SCHEMA = "vec_id bigint, embedding array<float>, tie string, c int"


def test_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1 + 9 * (i % 7 == 0)) for _ in range(9)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties of one vector
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = brute(rows, 5, lambda q: q % 5 == 0)
    assert found(df) == want
    assert found(df, vafile.VaParams(block=16, queries=8, lanes=3)) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (5, [1.5]), (10, []), (1, [0.5, -1.0, 3.0]), (2, None), (15, [nan, 1.0]), (3, [inf]), (4, [1.0, None]),
            (None, [1.0, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (20, [0.0, 0.0])]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    assert found(df) == brute(rows, 5, lambda q: q % 5 == 0)
    assert found(df.limit(0)) == set()
    empty = spark.createDataFrame([(0, [], "t", 1), (1, [], "t", 1)], SCHEMA)
    assert found(empty) == {(0, 1, 1, 0)}
    huge = spark.createDataFrame([(0, [3e38], "t", 1), (1, [3e38], "t", 1), (2, [-3e38], "t", 1)], SCHEMA)
    assert found(huge) == {(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))}
