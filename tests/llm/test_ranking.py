"""Ranked search against scores worked out for every document."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from corpusloom.llm import ranking
from corpusloom.llm.ranking import RankParams, rank_documents


def terms_of(text):
    found = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]


def brute(docs, items, k=10):
    held = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    n_docs, n_words = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, c in held:
            score = 0
            for t, times in Counter(terms_of(text)).items():
                if c[t]:
                    w = floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 25 + (75 * c.total() * n_docs) // n_words
                    score += times * w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, row[3], -row[0]) for r, row in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(map(repr, out))


def corpus(seed, n=300):
    rng = random.Random(seed)
    common = ["the", "of", "É", "日本"]
    draw = lambda size: " ".join(rng.choice(common) if rng.random() < 0.5 else f"t{int(rng.paretovariate(0.5)) % 500}" for _ in range(size))
    docs = [(i * 7 % n, draw(rng.randrange(1, 60))) for i in range(n)]
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " ,;"), (None, docs[3][1]), (None, docs[3][1]), (5, docs[3][1]), (5, docs[3][1])]
    docs += [(n + 4, draw(5000)), (n + 5, docs[9][1]), (n + 6, docs[9][1].upper())]
    items = [(i, draw(rng.randrange(1, 25))) for i in range(30)]
    items += [(1, "the OF the"), (1, "the OF the"), (2, "t1 t2"), (90, None), (91, ""), (92, "unheard"), (None, "t1 t3"), (93, "the " * 50)]
    return docs, items


def tables(spark, docs, items):
    rows = spark.createDataFrame([(i, t, 3, "x") for i, t in docs], "doc_id bigint, text string, score int, `key` string")
    asked = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id bigint, text string, rank int")
    return rows, asked


@pytest.mark.parametrize(
    "params, words, step",
    [({}, 1 << 22, 2048), ({"block_bytes": 300}, 600, 16), ({"k": 3, "short": 0.0}, 2000, 64), ({"short": 1.0}, 2000, 8)],
)
def test_against_all_scores(spark, monkeypatch, params, words, step):
    monkeypatch.setattr(ranking, "BLOCK_WORDS", words)
    monkeypatch.setattr(ranking, "STEP", step)
    docs, items = corpus(len(params))
    rows, asked = tables(spark, docs, items)
    got = rank_documents(rows, asked, RankParams(**params))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(docs, items, params.get("k", 10))


def test_a_block_is_walked_only_where_bounds_reach_the_best(monkeypatch):
    """With good scores known, long lists are looked up but not walked; nothing is lost."""
    rng = np.random.default_rng(3)
    n = 4000
    lists = [(np.sort(rng.choice(n, size, replace=False)), rng.integers(1, top, size)) for size, top in ((9, 900), (40, 700), (2500, 60), (3900, 9))]
    total = np.zeros(n, np.int64)
    for docs, scores in lists:
        total[docs] += scores
    for known in (0, 5):
        best = ranking.Best(5)
        if known:
            best.add(np.sort(total)[-5:], [-9, -8, -7, -6, -5])
        seen = []
        real = np.flatnonzero
        monkeypatch.setattr(np, "flatnonzero", lambda x: seen.append(len(real(x))) or real(x))
        ranking.search_block(lists, n, list(range(n)), best, 1 / 32)
        monkeypatch.setattr(np, "flatnonzero", real)
        order = sorted(range(n), key=lambda d: (-total[d], d))[:5]
        want = sorted([(-int(total[d]), d) for d in order] + ([(-int(s), i) for s, i in zip(np.sort(total)[-5:], range(-9, -4))] if known else []))[:5]
        assert [(r[0], r[3]) for r in best.rows] == want
        if known:
            assert sum(seen) < 200  # accumulators only, of 4,000 documents


def test_empty_tables(spark):
    docs, items = corpus(1, 20)
    rows, asked = tables(spark, docs, items)
    assert rank_documents(rows.limit(0), asked).count() == 0
    assert rank_documents(rows, asked.limit(0)).count() == 0
