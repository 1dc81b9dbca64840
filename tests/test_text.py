import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("x")).first()["x"]


def many(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["x"] for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


URLS = [
    "http://www.example.com/2016/06/30/world/middleeast/a-road-to-b.html",
    "http://www.example.com/2016/6/3/sports/x.html",
    "http://www.example.com/2016/06/30/only-headline.html",
    "http://www.example.com/about.html",
    "http://www.example.com/2015/01/02/old/2016/03/04/arts/-/c-d.html",
    "http://www.example.com/2016/13/45/a/b.html",
    "http://www.example.com/16/01/02/a/b.html",
    "http://www.example.com/2016/06/30/",
]


def test_url_parts(spark):
    dates = many(spark, URLS, X.url_date("t").cast("string"))
    assert dates == [
        "2016-06-30", "2016-06-03", "2016-06-30", None, "2015-01-02", None, None, "2016-06-30",
    ]
    assert many(spark, URLS, X.url_tail("t"))[4] == "/arts/-/c-d.html"
    categories = many(spark, URLS, X.news_category("t"))
    assert categories == ["world-middleeast", "sports", "", None, "arts", "a", "a", ""]
    headlines = many(spark, URLS, X.headline("t"))
    assert headlines == ["a road to b", "x", "only headline", None, "c d", "b", "b", ""]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("WASHINGTON — Stellar pitching", "Stellar pitching"),
        ("NEW YORK. A b, c. — d — e", "d — e"),
        ("no capital — stays", "no capital — stays"),
        ("Quote: “A” — stays", "Quote: “A” — stays"),
        ("A— stays", "A— stays"),
        ("AB— goes", "goes"),
        ("PARIS 2016 — digits stay", "PARIS 2016 — digits stay"),
        (" WASHINGTON — leading space stays ", "WASHINGTON — leading space stays"),
        ("ROME  — goes", "goes"),
    ],
)
def test_dateline(spark, text, expected):
    assert one(spark, text, X.remove_dateline("t")) == expected


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="ABab ,.—1 \n", max_size=14), min_size=300, max_size=300))
def test_dateline_equals_the_long_pattern(spark, texts):
    long_pattern = re.compile(r"\b[A-Z\s]+[,.]*[A-Za-z\s,.]+—")
    expected = [t[m.end():].strip() if (m := long_pattern.match(t)) else t.strip() for t in texts]
    assert many(spark, texts, X.remove_dateline("t")) == expected


def test_dateline_is_linear_in_long_capitals(spark):
    text = "A " * 500_000
    assert one(spark, text, F.length(X.remove_dateline("t"))) == len(text.strip())


def test_strip_takes_all_unicode_space(spark):
    spaces = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
    assert one(spark, spaces + "a b" + spaces, X.strip("t")) == "a b"
    assert set(spaces) == set(C.WHITESPACE)


@pytest.mark.parametrize("char", ["가", "힣", "ぁ", "ヿ", "一", "鿿"])
def test_cjk_is_detected(spark, char):
    assert one(spark, f"abc {char} d", X.has_no_cjk("t")) is False


def test_other_scripts_are_kept(spark):
    assert many(spark, ["plain", "é ß ñ", "Привет", ""], X.has_no_cjk("t")) == [True] * 4


def test_sign_up_and_underscores(spark):
    listed = f"WASHINGTON — x {C.SIGN_UP_SENTENCE} y"
    straight = listed.replace("’", "'")
    assert many(spark, [listed, straight, "a__b_"], X.clean_text("t")) == [
        "", straight.removeprefix("WASHINGTON — "), "ab",
    ]


def test_clean_text_equals_its_steps(spark):
    sign_up = C.SIGN_UP_SENTENCE
    texts = [
        f"ROME — {sign_up}", f"{sign_up} — x", f"ROME {sign_up}—x", f" {sign_up} ", f"A_B — {sign_up[:-1]}",
        "ROME — a_b", "_", " _ _ ", "ROME—", "ROME — ", f"x_{sign_up}_y", sign_up.replace("e", "_e"),
    ]
    steps = X.remove_underscores(X.blank_sign_up_lists(X.remove_dateline("t")))
    assert many(spark, texts, X.clean_text("t")) == many(spark, texts, steps)


def test_cleaning_twice_changes_nothing_after_a_dateline(spark):
    texts = ["PARIS — a_b", "plain text", "  spaced  "]
    once = many(spark, texts, X.clean_text("t"))
    assert many(spark, once, X.clean_text("t")) == once


def test_sentences(spark):
    text = "One two.  Three!\nFour? five e.g. six.Seven"
    assert one(spark, text, X.sentences("t")) == [
        "One two.", "Three!", "Four?", "five e.g.", "six.Seven",
    ]
