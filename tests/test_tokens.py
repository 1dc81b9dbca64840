from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom import session
from corpusloom.functions import tokens as K
from corpusloom.operators import lookups as J
from corpusloom.operators import tokens as T

TEXTS = [
    "The U.S. e-mail --- of 2016, and 12 ab abc",
    "x" * 120,
    "",
    "MiXeD Case's don't",
    "a" * 50 + " " + "b" * 51 + " é naïve",
    None,
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, content string")


def column(df, name):
    return [r[name] for r in df.orderBy("doc_id").collect()]


def test_tokenize_cases(docs):
    tokens = column(T.tokenize(docs), "words")
    assert tokens[0] == ["the", "e-mail", "---", "2016", "and", "abc"]
    assert [len(t) for t in tokens[1]] == [50, 50, 20]
    assert tokens[2] == [] and tokens[5] == []
    assert tokens[3] == ["mixed", "case", "don"]
    assert [len(t) for t in tokens[4]] == [50, 50]


def test_tokenize_equals_the_ml_tokenizer(docs):
    texts = docs.filter("content is not null")
    ml = RegexTokenizer(inputCol="content", outputCol="ml", pattern=C.TOKEN_PATTERN, gaps=False)
    both = ml.transform(T.tokenize(texts))
    assert both.filter("words <> ml").count() == 0


def test_clean_text_keeps_case_on_request(docs):
    cleaned = T.clean_text(T.clean_text(docs), out="cased", lowercase=False)
    assert cleaned.filter("doc_id = 3").first()["clean"] == "mixed case don"
    assert cleaned.filter("doc_id = 3").first()["cased"] == "MiXeD Case don"


STOP = ["The", "and", "don't", "abc", "it's", "back\\slash"]


def test_stopwords_keep_repeats_and_ignore_case(spark):
    docs = spark.createDataFrame([(1, ["a", "THE", "b", "a", "And", "x"])], "doc_id long, words array<string>")
    assert T.remove_stopwords(docs, STOP).first()["words_filtered"] == ["a", "b", "a", "x"]
    ml = StopWordsRemover(inputCol="words", outputCol="ml", stopWords=STOP)
    assert ml.transform(docs).first()["ml"] == ["a", "b", "a", "x"]


def test_no_stopwords(spark):
    docs = spark.createDataFrame([(1, ["a"])], "doc_id long, words array<string>")
    assert T.remove_stopwords(docs, []).first()["words_filtered"] == ["a"]


@pytest.fixture
def lemmas(spark):
    rows = [("tasks", "task"), ("tasked", "task"), ("taught", "teach"), ("the", "thee")]
    return spark.createDataFrame(rows, "form string, lemma string")


@pytest.fixture
def words(spark):
    rows = [(1, ["tasks", "taught", "other", "tasks"]), (2, []), (3, ["the"])]
    return spark.createDataFrame(rows, "doc_id long, words_filtered array<string>")


EXPECTED = [["task", "teach", "other", "task"], [], ["thee"]]


def test_lemmatize_in_the_row(words, lemmas):
    out = T.lemmatize(words, lemmas)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert column(out, "tokens") == EXPECTED


def test_lemmatize_by_join(words, lemmas, monkeypatch):
    monkeypatch.setattr(T, "fits_inline", lambda rows, size: False)
    assert column(T.lemmatize(words, lemmas), "tokens") == EXPECTED


def test_lemmatize_by_shuffled_join(words, lemmas, monkeypatch):
    monkeypatch.setattr(T, "fits_inline", lambda rows, size: False)
    monkeypatch.setattr(J, "fits_broadcast", lambda rows, size: False)
    assert column(T.lemmatize(words, lemmas), "tokens") == EXPECTED


def hot_docs(spark, n=400):
    """Documents in which one word is a third of all tokens and thousands occur once."""
    rows = [(i, ["hot", f"rare{i}", "none", "hot" if i % 2 else f"more{i}", "HOT", None]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_the_sketch_names_frequent_words_only(spark):
    tokens = J.explode_tokens(hot_docs(spark))
    heavy = J.heavy_values(tokens, "token")
    assert {"hot", "none", "HOT"} <= set(heavy) and len(heavy) <= J.HEAVY
    assert J.heavy_values(tokens.limit(0), "token") == []
    numbers = spark.range(5000).select((F.col("id") % 1250 * (F.col("id") % 2)).alias("id"))
    assert 0 in J.heavy_values(numbers, "id")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_and_rare_words_join_alike(spark, monkeypatch, how):
    tokens = J.explode_tokens(hot_docs(spark))
    lookup = spark.createDataFrame([("hot", "h"), ("none", "n"), ("rare7", "r"), ("absent", "x")], "token string, lemma string")
    want = sorted(map(str, J.lookup_join(tokens, lookup, "token", how).collect()))
    monkeypatch.setattr(J, "fits_broadcast", lambda rows, size: False)
    joined = J.lookup_join(tokens, lookup, "token", how)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, joined.collect())) == want and "explode(sequence" not in plan


def test_a_form_filter_misses_nothing(spark, monkeypatch):
    forms = spark.range(3000).select(F.concat(F.lit("form"), "id").alias("form"))
    others = spark.range(20_000).select(F.concat(F.lit("other"), "id").alias("form"))
    held = K.FormFilter(forms, "form", 3000)
    assert forms.filter(~held.may_hold(F.col("form"))).count() == 0
    assert others.filter(held.may_hold(F.col("form"))).count() < 400
    assert spark.range(1).select(held.may_hold(F.lit(None).cast("string")).alias("x")).first()["x"] is None
    monkeypatch.setattr(K.FormFilter, "MAX_BITS", 1 << 10)
    full = K.FormFilter(forms, "form", 3000)
    assert forms.filter(~full.may_hold(F.col("form"))).count() == 0


@pytest.mark.parametrize("small", [True, False])
def test_only_tokens_that_may_have_an_entry_leave_their_row(spark, monkeypatch, small):
    monkeypatch.setattr(J, "fits_broadcast", lambda rows, size: small)
    lookup = spark.createDataFrame([("hot", "h"), ("rare7", "r"), ("rare9", None), ("HOT", None)], "form string, lemma string")
    docs = hot_docs(spark)
    out = J.rewrite_tokens(docs, lookup, "tokens", "out")
    change = {"hot": "h", "rare7": "r", "rare9": None, "HOT": None}
    for r in out.collect():
        want = [change.get(t, t) for t in r["tokens"] if t is not None]
        assert r["out"] == [t for t in want if t is not None]
    held = K.FormFilter(lookup, "form", 4)
    leaving = docs.select(F.explode("tokens").alias("t")).filter(held.may_hold(F.col("t")) & ~F.col("t").isin("hot", "HOT", "none"))
    assert leaving.count() <= 2 + 30


@pytest.mark.parametrize("small", [True, False])
def test_stopwords_by_join(spark, words, monkeypatch, small):
    monkeypatch.setattr(T, "INLINE_WORDS", 1)
    monkeypatch.setattr(J, "fits_broadcast", lambda rows, size: small)
    listed = spark.createDataFrame([("Tasks",), ("the",), ("zzz",)], "word string")
    out = T.remove_stopwords(words, listed, tokens="words_filtered", out="kept")
    assert column(out, "kept") == [["taught", "other"], [], []]


def test_large_inline_lookup(spark):
    rows = [(f"form{i}", f"lemma{i % 97}") for i in range(5000)]
    lookup = spark.createDataFrame(rows, "form string, lemma string")
    table = K.InlineLookup(lookup, "form", "lemma", 5000)
    out = lookup.select("form", "lemma", table.get(F.col("form")).alias("found"))
    assert out.filter("found is null or found <> lemma").count() == 0
    assert spark.range(1).select(table.get(F.lit("absent")).alias("x")).first()["x"] is None


def test_empty_lookup(spark, words):
    nothing = spark.createDataFrame([], "form string, lemma string")
    assert column(T.lemmatize(words, nothing), "tokens") == column(words, "words_filtered")


def test_lemma_that_is_a_stopword_survives(spark, lemmas):
    docs = spark.createDataFrame([(1, "tasks task the")], "doc_id long, content string")
    assert T.preprocess(docs, ["task"], lemmas).first()["tokens"] == ["task", "thee"]


def test_alphabetic_variant(spark, lemmas):
    docs = spark.createDataFrame([(1, "well-taught 2016 Tasks naïve the")], "doc_id long, content string")
    plain = T.preprocess(docs, ["the"], lemmas, alpha_only=True)
    assert plain.first()["tokens"] == ["task"]
    broken = T.preprocess(docs, ["the"], lemmas, alpha_only=True, break_hyphens=True)
    assert broken.first()["tokens"] == ["well", "teach", "task"]


def test_remove_words_and_joining(spark):
    docs = spark.createDataFrame([(1, ["Mr", "-PRON-", "x", "!", "woman", "x"])], "doc_id long, tokens array<string>")
    out = T.join_tokens(T.remove_words(docs), "tokens", "joined")
    assert out.first()["joined"] == "x x"
    assert T.split_words(out, "joined", "again").first()["again"] == ["x", "x"]


def test_split_words_of_blank_text(spark):
    blank = spark.createDataFrame([(1, ""), (2, "  ")], "doc_id long, words_joined string")
    assert column(T.split_words(blank), "tokens") == [[], []]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "é", "-"]), max_size=9), min_size=200, max_size=200))
def test_count_terms(spark, lists):
    docs = spark.createDataFrame(list(enumerate(lists)), "doc_id long, tokens array<string>")
    counted = docs.select("doc_id", K.count_terms("tokens").alias("c")).orderBy("doc_id").collect()
    assert [{t: n for t, n in (r["c"] or [])} for r in counted] == [dict(Counter(x)) for x in lists]


def test_count_terms_needs_no_shuffle(docs):
    plan = T.tokenize(docs).select(F.inline(K.count_terms("words")))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


AWKWARD = [(1, ["Alpha", "beta", "null", "gamma"]), (1, ["beta", "delta"]), (2, []), (3, None), (4, ["beta", "beta", "x"]),
           (4, ["beta", "beta", "x"]), (None, ["gamma"]), (None, ["delta", "beta"])]


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_ROWS": 0}])
def test_all_paths_give_the_same_rows(spark, monkeypatch, limits):
    """Inline, broadcast and salted lookups on nulls, repeated forms, repeated and missing keys."""
    from corpusloom import session

    for name, value in limits.items():
        monkeypatch.setattr(session, name, value)
    docs = spark.createDataFrame(AWKWARD, "doc_id bigint, tokens array<string>")
    words = spark.createDataFrame([("BETA",), (None,), ("beta",)], "word string")
    lemmas = spark.createDataFrame(
        [("gamma", "g2"), ("gamma", "g1"), (None, "n"), ("delta", None), ("Alpha", "a"), ("beta", "b")], "form string, lemma string"
    )

    def rows(df):
        return sorted(((r["doc_id"], r["out"]) for r in df.collect()), key=str)

    kept = [rows(T.remove_stopwords(docs, words, "tokens", "out", strategy=s)) for s in ("auto", "join")]
    assert kept[0] == kept[1] == sorted(
        [(1, ["Alpha", "null", "gamma"]), (1, ["delta"]), (2, []), (3, None), (4, ["x"]), (4, ["x"]), (None, ["gamma"]), (None, ["delta"])], key=str
    )
    mapped = [rows(T.lemmatize(docs, lemmas, "tokens", "out", strategy=s)) for s in ("auto", "join")]
    assert mapped[0] == mapped[1] == sorted(
        [(1, ["a", "b", "null", "g1"]), (1, ["b", "delta"]), (2, []), (3, None), (4, ["b", "b", "x"]), (4, ["b", "b", "x"]),
         (None, ["g1"]), (None, ["delta", "b"])], key=str
    )


def test_a_dictionary_beyond_the_inline_limits_is_probed_without_a_shuffle(spark, monkeypatch):
    """All three ways give the same rows; nulls, empty rows and equal keys included."""
    monkeypatch.setattr(session, "INLINE_ROWS", 2)
    rows = [(1, ["cats", None, "dog"]), (1, ["dogs"]), (None, []), (2, None), (3, ["cats"] * 3 + ["Cats", ""]), (None, ["mice"])]
    docs = spark.createDataFrame(rows, "doc_id long, words_filtered array<string>").coalesce(1)
    lemmas = spark.createDataFrame(
        [("cats", "cat"), ("dogs", "dog"), ("dogs", "hound"), ("mice", "mouse"), (None, "x"), ("dog", None)], "form string, lemma string"
    )
    probed = T.lemmatize(docs, lemmas)
    assert "Exchange" not in probed._jdf.queryExecution().executedPlan().toString()
    got = sorted((repr(r["doc_id"]), repr(r["tokens"])) for r in probed.collect())
    want = [(1, ["cat", None, "dog"]), (1, ["dog"]), (None, []), (2, None), (3, ["cat"] * 3 + ["Cats", ""]), (None, ["mouse"])]
    assert got == sorted((repr(k), repr(t)) for k, t in want)
    assert probed.dtypes == T.lemmatize(docs, lemmas, strategy="join").dtypes


def test_the_plan_of_a_lookup_by_join_does_not_grow_with_the_dictionary(spark):
    """The driver writes plans out again and again; a filter of 2 MB in the expression made them 200 MB."""
    docs = spark.createDataFrame([(1, ["w5", "x"]), (2, None), (3, [None, "w7"])], "doc_id long, tokens array<string>")
    sizes = []
    for n in (10, 50_000):
        lookup = spark.range(n).select(F.concat(F.lit("w"), "id").alias("form"), F.concat(F.lit("l"), "id").alias("lemma"))
        out = J.rewrite_tokens(docs, lookup, "tokens", "out")
        assert {r["doc_id"]: r["out"] for r in out.collect()} == {1: ["l5", "x"], 2: None, 3: ["l7"]}
        sizes.append(len(out._jdf.queryExecution().toString()))
    assert sizes[1] < 1.5 * sizes[0]


def test_a_form_filter_tests_lists_as_it_tests_words(spark):
    forms = spark.range(500).select(F.concat(F.lit("form"), "id").alias("form"))
    held = K.FormFilter(forms, "form", 500)
    rows = spark.createDataFrame([(["form1", None, "other", "form499"],), ([],), (None,)], "words array<string>").coalesce(1)
    got = [r["held"] for r in rows.select(held.may_hold_each(F.col("words")).alias("held")).collect()]
    assert got[0][:2] == [True, None] and got[0][3] is True and got[1:] == [[], None]
