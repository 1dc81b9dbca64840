import math
import random
from collections import Counter

import pytest
from pyspark.ml.feature import IDF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corpusloom.operators import lookups as J
from corpusloom.operators import profile as P
from corpusloom.operators import vocab as V
from corpusloom.operators import wordlists as L


@pytest.fixture(scope="module")
def lists():
    rng = random.Random(3)
    names = [f"w{i}" for i in range(60)]
    return [[names[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(0, 30))] for _ in range(100)]


@pytest.fixture
def docs(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>")


def stats_of(lists):
    df = Counter(t for tokens in lists for t in set(tokens))
    cf = Counter(t for tokens in lists for t in tokens)
    return df, cf


def as_rows(vocab):
    return [tuple(r) for r in vocab.orderBy("term_id").collect()]


def numbered(terms, df, cf):
    return [(i, t, df[t], cf[t]) for i, t in enumerate(terms)]


def test_term_stats_and_counts(docs, lists):
    df, cf = stats_of(lists)
    assert {r["term"]: (r["df"], r["cf"]) for r in V.term_stats(docs).collect()} == {
        t: (df[t], cf[t]) for t in df
    }
    counts = {(r["doc_id"], r["term"]): r["tf"] for r in V.term_counts(docs).collect()}
    assert counts == {(i, t): n for i, tokens in enumerate(lists) for t, n in Counter(tokens).items()}


@pytest.mark.parametrize("size", [3, 10, 1000])
@pytest.mark.parametrize("low, high", [(0.02, 0.8), (0.1, 0.3), (0.0, 1.0)])
def test_vocabulary_by_corpus_frequency(docs, lists, size, low, high):
    df, cf = stats_of(lists)
    kept = [t for t in df if low * 100 <= df[t] <= high * 100]
    terms = sorted(kept, key=lambda t: (-cf[t], t))[:size]
    vocab = V.build_vocab(docs, min_df_frac=low, max_df_frac=high, size=size)
    assert as_rows(vocab) == numbered(terms, df, cf)


@pytest.mark.parametrize("size", [1, 7, 25, 1000])
@pytest.mark.parametrize("order", ["cf", "df", "alphabetical"])
def test_vocabulary_cut_without_lower_share(docs, lists, size, order):
    df, cf = stats_of(lists)
    ranked = df if order == "df" else cf
    terms = sorted((t for t in df if df[t] <= 80), key=lambda t: (-ranked[t], t))[:size]
    if order == "alphabetical":
        terms.sort()
    vocab = V.build_vocab(docs, min_df_count=0.02, max_df_frac=0.8, size=size, order=order)
    assert as_rows(vocab) == numbered(terms, df, cf)


def test_cut_through_a_tie_goes_by_term(spark):
    rows = [(i, ["same", f"t{i:02d}"]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vocab = V.build_vocab(docs, size=4, order="df")
    assert [r[1] for r in as_rows(vocab)] == ["same", "t00", "t01", "t02"]


def test_bounds_are_inclusive_and_counts_apply(docs, lists):
    df, _ = stats_of(lists)
    vocab = V.build_vocab(docs, min_df_count=5, max_df_count=9, size=1000)
    assert {r[1] for r in as_rows(vocab)} == {t for t in df if 5 <= df[t] <= 9}


def test_an_unbounded_vocabulary_is_refused(docs):
    for bounds in ({"min_df_count": 1}, {"min_df_frac": 0.0}, {"min_df_frac": 1e-12}):
        with pytest.raises(ValueError):
            V.build_vocab(docs, **bounds)


def test_vectors_agree_with_rows(docs, lists):
    vocab = V.build_vocab(docs, min_df_frac=0.05, max_df_frac=0.8, size=20).cache()
    bags = {(r["doc_id"], r["term_id"]): r["tf"] for r in V.bag_of_words(docs, vocab).collect()}
    vectors = V.vectorize(docs, vocab).select("doc_id", F.posexplode(vector_to_array("features")))
    cells = {(r["doc_id"], r["pos"]): int(r["col"]) for r in vectors.filter("col > 0").collect()}
    assert bags == cells and bags
    named = J.name_terms(V.bag_of_words(docs, vocab), vocab)
    assert named.filter("term is null").count() == 0
    known = J.known_terms(V.term_counts(docs), vocab)
    assert known.count() == len(bags)


def test_idf_agrees_with_spark_ml(docs):
    vocab = V.build_vocab(docs, min_df_frac=0.05, max_df_frac=0.8, size=20).cache()
    vectors = V.vectorize(docs, vocab)
    model = IDF(inputCol="features", outputCol="idf").fit(vectors)
    rows = V.tf_idf(V.bag_of_words(docs, vocab), vocab, V.doc_count(docs)).collect()
    by_id = {r["term_id"]: r["idf"] for r in rows}
    assert all(math.isclose(model.idf[i], value, rel_tol=1e-12) for i, value in by_id.items())


def test_value_counts(spark):
    values = ["b", "a", None, "b", "c", "a", "d"]
    df = spark.createDataFrame([(v,) for v in values], "k string")
    assert [tuple(r) for r in P.value_counts(df, "k", top=3).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert [r[0] for r in P.value_counts(df, "k", top=3, ascending=True).collect()] == ["c", "a", "b"]


def test_profile_and_first_rows(spark):
    df = spark.createDataFrame(
        [(i, f"c{i % 3}" if i else None, f"2016-01-{i + 1:02d}") for i in range(10)],
        "doc_id long, news_category string, date string",
    ).repartition(4)
    assert tuple(P.corpus_profile(df).first()) == (10, 3, "2016-01-01", "2016-01-10")
    assert [r[0] for r in P.first_rows(df, 3).collect()] == [0, 1, 2]
    assert [r[0] for r in P.last_rows(df, 2).collect()] == [9, 8]


def test_light_verbs(spark):
    lookup = spark.createDataFrame([("asks", "ask"), ("asked", "ask"), ("x", "y")], "form string, lemma string")
    roots = spark.createDataFrame([("ask",), ("go",)], "word string")
    words = sorted(r["word"] for r in L.expand_roots(roots, lookup).collect())
    assert words == ["ask", "asked", "asks", "go"]


def test_build_stopwords(spark):
    base = L.base_stopwords(spark)
    built = L.build_stopwords(base, L.word_classes(spark), L.light_verb_roots(spark))
    words = [r["word"] for r in built.collect()]
    assert len(words) == len(set(words)) and {"the", "mr.", "monday", "think"} <= set(words)


def test_vectors_by_joining_equal_those_of_the_model(spark, monkeypatch):
    """Beyond the inline limits no term is collected; rows without known terms have empty vectors."""
    rows = [(1, ["b", "a", "b", "z"]), (2, []), (3, None), (4, ["zz"]), (None, ["c", "a"]), (1, ["b", "a", "b", "z"]), (1, ["c", None])]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vocab = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "term_id int, term string")
    small = sorted(map(str, V.vectorize(docs, vocab).collect()))
    monkeypatch.setattr(V, "fits_inline", lambda rows, size: False)
    monkeypatch.setattr(V, "terms_in_order", None)
    joined = V.vectorize(docs, vocab)
    assert joined.schema["features"].dataType.simpleString() == "vector"
    assert sorted(map(str, joined.collect())) == small and len(small) == len(rows)
