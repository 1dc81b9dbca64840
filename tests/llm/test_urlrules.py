"""URL rules on awkward rows; the whole query is compared with its SQL by the registry tests."""

from corpusloom.llm import urlrules

RULES = [urlrules.site_rule("com", "/", "block"), urlrules.site_rule("a.com", "/x", "allow"),
         urlrules.word_rule("casino"), urlrules.Rule("open", "zz", (), "block", 1)]


def test_awkward_urls(spark):
    urls = [(1, "http://A.com/xyz"), (2, "http://b.a.com/y"), (3, "http://com"), (4, None), (5, ""), (6, "no scheme/casino"),
            (7, "http://h.org/Casino?x"), (8, "http://h.org/casinos"), (9, "http://xcom/"), (10, "http://h.org/fizz"),
            (11, "http://h.org/" + "q" * 200_000), (1, "http://A.com/xyz"), (None, "http://h.org/a#casino")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in urls], "page_id bigint, url string, rule string")
    got = urlrules.judge_urls(pages, urlrules.rule_table(spark, RULES)).collect()
    rules = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert len(got) == len(urls)
    assert rules[1] == ("a.com/x", "allow") and rules[2] == ("com/", "block")
    assert all(rules[i] == (None, "allow") for i in (3, 4, 5, 6, 8, 9, 11, None))
    assert rules[7] == ("word:casino", "block") and rules[10] == ("open", "block")
    assert urlrules.judge_urls(pages.limit(0), urlrules.rule_table(spark, RULES)).count() == 0
