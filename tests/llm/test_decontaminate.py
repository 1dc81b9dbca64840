"""Benchmark windows in documents against a search from the definition."""

import hashlib
import random
import re
from math import ceil

import pytest

from corpusloom.llm import decontaminate, queries, terms
from corpusloom.llm.decontaminate import LeakParams, find_leaks


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, window=10, width=3, least=1.0):
    """``[(doc_id, n_words, hit positions, items)]`` by comparing every slice with every window."""
    windows = set()
    for item, text in items:
        w = words_of(text)
        m = min(window, len(w))
        if item is not None and m:
            windows |= {(str(item), tuple(w[i : i + m])) for i in range(len(w) - m + 1)}
    out = []
    for doc_id, text in docs:
        w, hit, held = words_of(text), set(), set()
        for item, g in windows:
            own = min(width, len(g))
            s = len(g) - own + 1
            for p in range(len(w) - len(g) + 1):
                same = sum(tuple(w[p + i : p + i + own]) == g[i : i + own] for i in range(s))
                if same >= max(1, ceil(least * s)):
                    hit |= set(range(p, p + len(g)))
                    held.add(item)
        out.append((doc_id, len(w), sorted(hit), sorted(held)))
    return out


def positions(spans):
    return [x for b, e in zip(spans[::2], spans[1::2]) for x in range(b, e)]


def compare(spark, docs, items, **params):
    rows = spark.createDataFrame(
        [(i, t, 1, "s", 2) for i, t in docs], "doc_id bigint, text string, n_words int, items string, block int"
    )
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id bigint, text string, words int")
    got = find_leaks(rows, asked, LeakParams(**params))
    assert got.columns == ["doc_id", "n_words", "spans", "items"]
    found = [(r["doc_id"], r["n_words"], positions(r["spans"]), r["items"]) for r in got.collect()]
    fixed = {k: v for k, v in params.items() if k != "block_bytes"}
    assert sorted(map(repr, found)) == sorted(map(repr, brute(docs, items, **fixed)))
    return found


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", "é", "x1", "日本", "w"] + [f"v{i}" for i in range(12)]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, draw(rng.choice([1, 2, 4, 10, 14, 30]))) for i in range(25)]
    items += [(25, items[3][1]), (3, draw(12)), (26, None), (27, " ., "), (None, "the of a"), (28, "A  The, OF")]
    docs = [(i, draw(rng.randrange(60))) for i in range(30)]
    for i in range(30, 60):
        passage = rng.choice(items[:25])[1].split()
        at = rng.randrange(len(passage))
        docs.append((i, ". ".join([draw(rng.randrange(9)), " ".join(passage[:at]).upper(), ", ".join(passage[at:]), draw(5)])))
    docs += [(60, None), (61, ""), (62, "..."), (None, items[4][1]), (63, docs[40][1]), (40, docs[40][1]), (40, docs[40][1])]
    return docs, items


@pytest.mark.parametrize("params", [{}, {"block_bytes": 400}, {"least": 0.6, "window": 8}, {"least": 0.5, "width": 2, "block_bytes": 300}])
def test_against_every_slice(spark, params):
    docs, items = corpus(7)
    found = compare(spark, docs, items, **params)
    assert sum(bool(hit) for _, _, hit, _ in found) > 20


def test_hits_end_with_their_documents(spark):
    passage = " ".join(f"p{i}" for i in range(10))
    docs = [(1, passage), (2, passage), (3, ""), (4, "p9 " + passage), (5, " ".join(passage.split()[5:])), (6, " ".join(passage.split()[:5]))]
    found = compare(spark, docs, [(1, passage)])
    assert {i: len(hit) for i, _, hit, _ in found} == {1: 10, 2: 10, 3: 0, 4: 10, 5: 0, 6: 0}


def test_long_texts_and_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 16)
    rng = random.Random(2)
    long = [f"u{rng.randrange(40)}" for _ in range(400)]
    docs = [(1, " ".join(long)), (2, " ".join(long[100:160])), (3, "z" * 5000), (4, " ".join(long[5:14]))]
    compare(spark, docs, [(1, " ".join(long[90:300])), (2, " ".join(long[::-1]))])
    text = ("é, " * 3_000_000 + " ".join(long)).encode()
    parts = list(terms.term_parts(text, 1 << 20))
    assert len(parts) > 5 and [w for p in parts for w in p] == terms.terms(text)


def test_a_passage_shared_by_most_documents_and_items(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(i, f"{passage} tail{i}" if i % 3 else f"other{i} words") for i in range(300)]
    items = [(i, passage) for i in range(40)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = find_leaks(rows, asked, LeakParams(block_bytes=1000)).collect()
    assert all(len(positions(r["spans"])) == (14 if r["doc_id"] % 3 else 0) for r in got)
    assert all(r["items"] == (sorted(map(str, range(40))) if r["doc_id"] % 3 else []) for r in got)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert find_leaks(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in find_leaks(docs, items.limit(0)).collect()] == [(1, 3, [], [])]


def test_whole_query_against_the_definition(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(len(w) - 9):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    want = {}
    for doc_id, text in docs:
        w, hit, held = words_of(text), set(), set()
        for p in range(len(w) - 9):
            if found := windows.get(tuple(w[p : p + 10])):
                hit |= set(range(p, p + 10))
                held |= found
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        want[doc_id] = (len(w), len(hit), len(held), digest, bool(hit))
    got = {r["doc_id"]: tuple(r)[1:6] for r in queries.op11_decontaminate(spark, sf_dir).collect()}
    assert got == want and any(v[4] for v in want.values())
