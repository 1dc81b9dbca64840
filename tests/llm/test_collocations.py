"""Phrases from merged stripes against counts from the definition."""

import random
import re
from collections import Counter

import pytest

from corpusloom.llm import collocations
from corpusloom.llm.collocations import PhraseParams


def pieces_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", lowered)]


def brute(docs, longest=3, least=10, within=50, top=2000):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for w in pieces_of(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    rows = {}
    for (lang, p), a in found.items():
        if any(own == lang and len(q) > len(p) and inside(p, q) and 100 * b >= within * a for (own, q), b in found.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        phrase = " ".join(p)
        rows.setdefault(lang, []).append((-score, -a, phrase.encode(), phrase, a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang, held in rows.items():
        for rank, r in enumerate(sorted(held, key=lambda r: r[:3])[:top]):
            out.append((lang, rank + 1, *r[3:]))
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = ["New", "York", "City", "of", "the", "é", "日本", "\x85x", "a\x00b", "\xa0", "zz", "Of"]
    draw = lambda size: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!?", " ; "]) for _ in range(size))
    docs = [(rng.choice(["en", "en", "de", None, "und", ""]), draw(rng.randrange(30))) for _ in range(n)]
    docs += [("en", "New York City")] * 40 + [("de", None), (None, ""), ("fr", " . "), ("x", "solo")]
    return docs + [("en", "of the " * 3000), ("de", "long" * 5000)]


def table(spark, docs):
    return spark.createDataFrame([(t, l, 1, "p") for l, t in docs], "text string, lang string, f int, prefix string")


@pytest.mark.parametrize(
    "params, part, cut",
    [({}, 1 << 24, 1 << 20), ({"top": 5, "bits": 64}, 700, 50), ({"longest": 2}, 100, 1 << 20), ({"longest": 5, "least": 4, "within": 80}, 3000, 300)],
)
def test_against_all_counts(spark, monkeypatch, params, part, cut):
    monkeypatch.setattr(collocations, "PART", part)
    monkeypatch.setattr(collocations, "SLICE", cut)
    docs = corpus(part)
    got = collocations.collocations(table(spark, docs), PhraseParams(**params))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(docs, **{k: v for k, v in params.items() if k != "bits"})
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 5


def test_stripes_add_up_to_their_prefixes(spark):
    docs = corpus(5)
    levels = collocations.count_phrases(table(spark, docs), PhraseParams())
    f = Counter()
    for lang, text in docs:
        for w in pieces_of(text):
            f.update((lang or ("und" if lang is None else ""), " ".join(w[i : i + m])) for m in (1, 2) for i in range(len(w) - m + 1))
    for level in levels[1:]:
        sums = Counter()
        for r in level.filter("next is null").collect():
            sums[r["lang"], r["prefix"]] += r["f"]
        assert sums and all(f[key] == n for key, n in sums.items() if n >= 10)


def test_long_texts_are_cut_without_loss(monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice(["a", "bb", "c" * 30, "é"]) + rng.choice([" ", " ", ". ", "\t"]) for _ in range(900)).encode()
    whole = collocations.tokens(text)
    for ahead in (0, 1, 2):
        own = []
        for found, n in collocations._slices(text, ahead, 64):
            assert whole[len(own) : len(own) + len(found)] == found
            own += found[:n]
        assert own == whole


def test_empty_table(spark):
    assert collocations.collocations(table(spark, corpus(1)).limit(0)).count() == 0
