"""Similar vectors against all pairs."""

import math
import random

import numpy as np

from corpusloom.llm import covertree
from corpusloom.llm.common import Forest


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.98):
    n = len(rows)
    linked = [[] for _ in rows]
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    linked[i].append(j)
    least = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in linked[i]:
                if least[j] is not None and (least[i] is None or least[j] < least[i]):
                    least[i], changed = least[j], True
    return sorted(((r[0] is None, r[0] or 0, len(l), c is None, c or 0, r[0] is not None and c == r[0]) for r, l, c in zip(rows, linked, least)))


def found(df, params=covertree.CoverParams()):
    return sorted(
        (r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"] is None, r["component_id"] or 0, r["kept"])
        for r in covertree.similar_vectors(df, params).collect()
    )


SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, w int"


def test_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        centre = random.Random(i % 9 if i % 3 else 100 + i)
        base = [centre.gauss(0, 1) for _ in range(8)]
        noise = 0.01 if i % 5 else 0.08
        rows.append((i, [x + rng.gauss(0, noise) for x in base], i % 2))
    rows += [(1000 + i, rows[7][1], 1) for i in range(30)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    want = brute(rows)
    assert found(df) == want
    assert found(df, covertree.CoverParams(part=20, tops=4)) == want


def test_awkward_rows(spark):
    nan = float("nan")
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (3, v, 1), (5, v, 1), (None, v, 1), (9, v, None), (8, None, 1), (7, [0.0, 0.0, 0.0], 1), (6, [nan, 1.0, 1.0], 1),
            (4, [1.0, None, 2.0], 1), (2, [1.0, 2.0], 1), (1, [1.0, 2.01], 1), (None, [5.0, -1.0, 0.0], 2), (None, [5.0, -1.0, 0.0], 2),
            (11, v, 2), (12, [], 1)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], SCHEMA)
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []


def test_whole_nodes_are_counted_without_opening(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.array([1.0] + [0] * 15) + rng.normal(0, 1e-3, (500, 16))
    norm = np.linalg.norm(x, axis=1)
    tree, forest = covertree.CoverTree(x / norm[:, None], 0.2), Forest(500)
    w = np.ones(500)
    opened = []
    inner = covertree._opened
    monkeypatch.setattr(covertree, "_opened", lambda *a: opened.append(1) or inner(*a))
    to_a, _ = covertree.dual_links(tree, tree, w, w, (norm, norm), 0.98, forest, 0)
    assert (to_a == 500).all() and len(set(forest.roots().tolist())) == 1 and not opened
