"""Queries over article text: functions, filters, segmentation, article files."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as X
from corpusloom.operators import clean
from corpusloom.operators.segment import segment_lines
from corpusloom.operators.sentences import stop_statistics
from corpusloom.plans.articles import article_table
from corpusloom.queries.inputs import ARTICLES_CTE, URL_SQL, articles, table, urls, with_
from corpusloom.session import scratch_path, spread
from corpusloom.sources import articles as A
from corpusloom.sources import dump as D

# --- SQL pieces, written for RE2 and independent of the Spark expressions. ---

_WS = "'" + C.WHITESPACE + "'"
_RE_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DATE = "regexp_extract(url, '[0-9]+/[0-9]+/[0-9]+')"
_TAIL = (
    "CASE WHEN regexp_matches(url, '[0-9]+/[0-9]+/[0-9]+') "
    "THEN string_split_regex(url, '[0-9]+/[0-9]+/[0-9]+')[-1] END"
)
_DAY = (
    "CASE WHEN regexp_matches(" + _DATE + ", '^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$') "
    "THEN CAST(CAST(try_strptime(" + _DATE + ", '%Y/%m/%d') AS DATE) AS VARCHAR) END"
)
_CATEGORY = "trim(array_to_string(list_slice(string_split(" + _TAIL + ", '/'), 1, -2), '-'), '-')"
_HEADLINE = "replace(replace(string_split(" + _TAIL + ", '/')[-1], '.html', ''), '-', ' ')"
_ENGLISH = r"NOT regexp_matches({0}, '[\x{{ac00}}-\x{{d7a3}}\x{{3040}}-\x{{30ff}}\x{{4e00}}-\x{{9fff}}]')"
_SIGN_UP = "Want to get this briefing by email? Here’s the sign-up."


def _dateline(text: str) -> str:
    pattern = rf"^[A-Z][A-Z{_RE_WS}]*[,.]*[A-Za-z{_RE_WS},.]+—"
    # A single capital may be the whole first part, so the rest needs one more character.
    return f"trim(regexp_replace({text}, '{pattern}', ''), {_WS})"


def _cleaned(text: str) -> str:
    bare = _dateline(text)
    return f"replace(CASE WHEN contains({bare}, '{_SIGN_UP}') THEN '' ELSE {bare} END, '_', '')"


def _joined_lines(text: str) -> str:
    lines = rf"string_split(regexp_replace({text}, '\r\n|\r', chr(10), 'g'), chr(10))"
    stripped = f"list_transform({lines}, lambda x: trim(x, {_WS}))"
    return f"array_to_string(list_filter({stripped}, lambda x: x <> ''), ' ')"


_CLEAN_CTE = (
    f"clean AS (SELECT doc_id, url, content, {_DAY} AS date, {_HEADLINE} AS headline, "
    f"{_cleaned('content')} AS content_new FROM articles WHERE {_ENGLISH.format('content')})"
)
_ART = with_(ARTICLES_CTE)
_ART_CLEAN = with_(ARTICLES_CTE, _CLEAN_CTE)

# The dump keeps whole texts, one article after another in the order of the documents.
_BODY = "text || chr(10) || '  ' || chr(10) || ' mentions URL: inside '"
_DUMP_CTE = f"dump AS (SELECT doc_id, url, {_BODY} AS body FROM articles JOIN documents USING (doc_id))"


def _dump(spark, sf_dir: str, ordered: bool = False) -> str:
    """Write the documents as a raw dump, if asked for in their order, and return its folder."""
    path = scratch_path(spark, "dump")
    docs = table(spark, sf_dir, "documents")
    record = F.concat(F.lit(C.ARTICLE_PREFIX), "url", F.lit("\n"), "body")
    parts = docs.select("doc_id", F.expr(URL_SQL).alias("url"), F.expr(_BODY).alias("body"))
    parts = parts.orderBy("doc_id") if ordered else spread(parts, "doc_id")
    parts.select(record.alias("value")).write.text(path)
    return path


def _clean(spark, sf_dir):
    return clean.clean_articles(clean.describe_urls(articles(spark, sf_dir)))


def _day():
    return F.col("date").cast("string").alias("date")


def s1_dump_preview(spark, sf_dir):
    first = D.preview(D.read_dump(spark, _dump(spark, sf_dir, ordered=True)))
    number = F.row_number().over(W.orderBy("file", "position")).cast("bigint")
    return first.select(number.alias("n"), "line")


def s1_dump_lines(spark, sf_dir):
    lines = D.read_dump(spark, _dump(spark, sf_dir))
    return lines.agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(X.strip("value") == "").alias("blank_lines"),
        F.count_if(X.is_article_start("value")).alias("article_lines"),
    )


def s2_segment_files(spark, sf_dir):
    return D.segment_articles(spark, _dump(spark, sf_dir), keep_last=True).select("url", "content")


def s2_files_without_last(spark, sf_dir):
    """Leaving out the last article takes one from every file of the dump."""
    path = _dump(spark, sf_dir)
    count = lambda keep_last: D.segment_articles(spark, path, keep_last).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    whole, cut = count(True).withColumnRenamed("n", "articles"), count(False)
    both = whole.join(cut, "file", "left")
    return both.agg(
        F.sum("articles").alias("articles"), F.every(F.col("articles") - F.coalesce("n", F.lit(0)) == 1).alias("one_less")
    )


def s2_segment_all_lines(spark, sf_dir):
    """The default, which keeps the last article of a file."""
    return segment_lines(_conversation_lines(spark, sf_dir)).select(
        "file", F.col("article_no").cast("bigint"), "url", "content"
    )


def s2_segment_lines(spark, sf_dir):
    return segment_lines(_conversation_lines(spark, sf_dir), keep_last=False).select(
        "file", F.col("article_no").cast("bigint"), "url", "content"
    )


def _conversation_lines(spark, sf_dir):
    """Conversations as files of lines; every user turn but the first opens an article."""
    opened = F.when(
        (F.col("role") == "user") & (F.col("turn") > 0),
        F.concat(F.lit("URL: http://www.example.com/"), F.col("turn").cast("string"), F.lit(" \n"), "text"),
    ).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("file"),
        "turn",
        F.posexplode(F.split(opened, "\n")).alias("row", "line"),
    ).select("file", (F.col("turn") * (1 << 32) + F.col("row")).alias("line_no"), "line")


def _tsv(spark, sf_dir, multi_line=True):
    path = scratch_path(spark, "articles-tsv")
    A.write_articles(_clean(spark, sf_dir), path, fmt="tsv", multi_line=multi_line)
    return path


def s3_read_articles(spark, sf_dir):
    return A.read_articles(spark, _tsv(spark, sf_dir), multi_line=True).select(_day(), "content")


def s3_read_line_articles(spark, sf_dir):
    """One record per line, the default: line breaks within a text are spaces."""
    return A.read_articles(spark, _tsv(spark, sf_dir, multi_line=False)).select(_day(), "content")


def s4_read_articles_headline(spark, sf_dir):
    return A.read_articles(spark, _tsv(spark, sf_dir), keep_headline=True, multi_line=True).select(
        _day(), "headline", "content"
    )


def s4_read_line_headlines(spark, sf_dir):
    """One record per line, with the headline."""
    return A.read_articles(spark, _tsv(spark, sf_dir, multi_line=False), keep_headline=True).select(
        _day(), "headline", "content"
    )


def s5_write_articles(spark, sf_dir):
    path = scratch_path(spark, "articles")
    A.write_articles(_clean(spark, sf_dir), path)
    return spark.read.parquet(path).select(_day(), "headline", "content_new")


def p1_select_columns(spark, sf_dir):
    return clean.describe_urls(articles(spark, sf_dir)).select(_day(), "url", "content")


def p2_drop_column(spark, sf_dir):
    return articles(spark, sf_dir).drop("content")


def p3_rename_columns(spark, sf_dir):
    renamed = articles(spark, sf_dir).toDF("key", "link", "body")
    return renamed.withColumnRenamed("link", "address").withColumn("chars", F.length("body").cast("bigint"))


def p4_keep_english(spark, sf_dir):
    return clean.keep_english(articles(spark, sf_dir)).select("doc_id", "is_english")


def p5_drop_empty(spark, sf_dir):
    return _clean(spark, sf_dir).select("doc_id")


def f1_url_date(spark, sf_dir):
    return urls(spark, sf_dir).select("doc_id", X.url_date("url").cast("string").alias("date"))


def f1_url_date_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", X.url_date("url").cast("string").alias("date"), X.headline("url").alias("headline")
    )


def f2_url_tail(spark, sf_dir):
    return urls(spark, sf_dir).select("doc_id", X.url_tail("url").alias("tail"))


def f3_news_category(spark, sf_dir):
    return urls(spark, sf_dir).select("doc_id", X.news_category("url").alias("news_category"))


def f4_headline(spark, sf_dir):
    return urls(spark, sf_dir).select("doc_id", X.headline("url").alias("headline"))


def f5_remove_dateline(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", X.remove_dateline("content").alias("content"))


def f6_detect_cjk(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", X.has_no_cjk("content").alias("is_english"))


def f7_blank_sign_up(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", X.blank_sign_up_lists("content").alias("content"))


def f8_remove_underscores(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", X.remove_underscores("content").alias("content"))


def f9_clean_articles(spark, sf_dir):
    return _clean(spark, sf_dir).select("doc_id", _day(), "headline", "content_new")


def f10_strip(spark, sf_dir):
    return articles(spark, sf_dir).select("doc_id", X.strip("content").alias("content"))


def f11_join_lines(spark, sf_dir):
    docs = articles(spark, sf_dir)
    lines = F.split("content", r"\r\n|\r|\n")
    return docs.select(
        "doc_id",
        X.join_lines(lines).alias("joined"),
        F.lower("url").alias("lowered"),
        X.is_article_start(F.concat(F.lit("URL: "), "url")).alias("opens"),
        X.remove_article_prefix(F.concat(F.lit("URL: "), "url", F.lit(" "))).alias("address"),
    )


def f12_flatten(spark, sf_dir):
    words = F.flatten(F.transform(F.split("content", "\n"), lambda line: F.split(line, " ")))
    flat = articles(spark, sf_dir).select("doc_id", F.explode(words).alias("word"))
    return flat.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def f13_sentences(spark, sf_dir):
    return clean.explode_sentences(articles(spark, sf_dir)).select(
        "doc_id", F.col("pos").cast("bigint"), "sentence"
    )


def f13_stop_statistics(spark, sf_dir):
    """How often words have a full stop, from which abbreviations are learned."""
    found = stop_statistics(articles(spark, sf_dir))
    return found.filter("with_stop >= 3")


def e1_article_table(spark, sf_dir):
    described = article_table(spark, _dump(spark, sf_dir), keep_last=True)
    return described.select(_day(), "news_category", "headline", "content", "url")


QUERIES = {
    q.__name__: q
    for q in (
        s1_dump_preview, s1_dump_lines, s2_segment_files, s2_files_without_last, s2_segment_lines, s2_segment_all_lines,
        s3_read_articles, s3_read_line_articles, s4_read_articles_headline, s4_read_line_headlines, s5_write_articles, p1_select_columns, p2_drop_column,
        p3_rename_columns, p4_keep_english, p5_drop_empty, f1_url_date, f1_url_date_pages,
        f2_url_tail, f3_news_category, f4_headline, f5_remove_dateline, f6_detect_cjk,
        f7_blank_sign_up, f8_remove_underscores, f9_clean_articles, f10_strip, f11_join_lines,
        f12_flatten, f13_sentences, f13_stop_statistics, e1_article_table,
    )
}

_DUMP_LINES_CTE = (
    "dumped AS (SELECT doc_id, string_split('URL: ' || url || chr(10) || body, chr(10)) AS l FROM dump), "
    "numbered AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM dumped)"
)

ORACLES = {
    "s1_dump_preview": with_(ARTICLES_CTE, _DUMP_CTE, _DUMP_LINES_CTE)
    + f"SELECT row_number() OVER (ORDER BY doc_id, i) AS n, trim(line, {_WS}) AS line "
    "FROM numbered ORDER BY n LIMIT 30",
    "s1_dump_lines": with_(ARTICLES_CTE, _DUMP_CTE, _DUMP_LINES_CTE)
    + f"SELECT count(*) AS lines, count(*) FILTER (WHERE trim(line, {_WS}) = '') AS blank_lines, "
    "count(*) FILTER (WHERE starts_with(line, 'URL: ')) AS article_lines FROM numbered",
    "s2_segment_files": with_(ARTICLES_CTE, _DUMP_CTE)
    + f"SELECT url, {_joined_lines('body')} AS content FROM dump",
    "s2_segment_lines": f"""
WITH opened AS (
  SELECT conv_id, turn, string_split(CASE WHEN role = 'user' AND turn > 0
    THEN 'URL: http://www.example.com/' || CAST(turn AS VARCHAR) || ' ' || chr(10) || text
    ELSE text END, chr(10)) AS l FROM conversations),
lines AS (SELECT conv_id AS file, turn, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM opened),
counted AS (
  SELECT *, CAST(sum(CASE WHEN starts_with(line, 'URL: ') THEN 1 ELSE 0 END)
    OVER (PARTITION BY file ORDER BY turn, i) AS BIGINT) AS article_no FROM lines),
ranked AS (SELECT *, max(article_no) OVER (PARTITION BY file) AS n FROM counted)
SELECT file, article_no,
  max(CASE WHEN starts_with(line, 'URL: ') THEN replace(trim(line, {_WS}), 'URL: ', '') END) AS url,
  coalesce(string_agg(trim(line, {_WS}), ' ' ORDER BY turn, i)
    FILTER (WHERE NOT starts_with(line, 'URL: ') AND trim(line, {_WS}) <> ''), '') AS content
FROM ranked WHERE article_no > 0 AND article_no < n GROUP BY file, article_no""",
    "s3_read_articles": _ART_CLEAN + "SELECT date, content_new AS content FROM clean WHERE content_new <> ''",
    "s3_read_line_articles": _ART_CLEAN
    + r"SELECT date, regexp_replace(content_new, '\r\n|\r|\n', ' ', 'g') AS content FROM clean WHERE content_new <> ''",
    "s4_read_articles_headline": _ART_CLEAN
    + "SELECT date, headline, content_new AS content FROM clean WHERE content_new <> ''",
    "s4_read_line_headlines": _ART_CLEAN
    + r"SELECT date, headline, regexp_replace(content_new, '\r\n|\r|\n', ' ', 'g') AS content FROM clean WHERE content_new <> ''",
    "s2_files_without_last": "SELECT count(*) AS articles, true AS one_less FROM documents",
    "s5_write_articles": _ART_CLEAN + "SELECT date, headline, content_new FROM clean WHERE content_new <> ''",
    "p1_select_columns": _ART + f"SELECT {_DAY} AS date, url, content FROM articles",
    "p2_drop_column": _ART + "SELECT doc_id, url FROM articles",
    "p3_rename_columns": _ART
    + "SELECT doc_id AS key, url AS address, content AS body, length(content) AS chars FROM articles",
    "p4_keep_english": _ART
    + f"SELECT doc_id, true AS is_english FROM articles WHERE {_ENGLISH.format('content')}",
    "p5_drop_empty": _ART_CLEAN + "SELECT doc_id FROM clean WHERE content_new <> ''",
    "f1_url_date": _ART + f"SELECT doc_id, {_DAY} AS date FROM articles",
    "f1_url_date_pages": f"SELECT page_id, {_DAY} AS date, {_HEADLINE} AS headline FROM pages",
    "f2_url_tail": _ART + f"SELECT doc_id, {_TAIL} AS tail FROM articles",
    "f3_news_category": _ART + f"SELECT doc_id, {_CATEGORY} AS news_category FROM articles",
    "f4_headline": _ART + f"SELECT doc_id, {_HEADLINE} AS headline FROM articles",
    "f5_remove_dateline": _ART + f"SELECT doc_id, {_dateline('content')} AS content FROM articles",
    "f6_detect_cjk": _ART + f"SELECT doc_id, {_ENGLISH.format('content')} AS is_english FROM articles",
    "f7_blank_sign_up": _ART
    + f"SELECT doc_id, CASE WHEN contains(content, '{_SIGN_UP}') THEN '' ELSE content END AS content FROM articles",
    "f8_remove_underscores": _ART + "SELECT doc_id, replace(content, '_', '') AS content FROM articles",
    "f9_clean_articles": _ART_CLEAN
    + "SELECT doc_id, date, headline, content_new FROM clean WHERE content_new <> ''",
    "f10_strip": _ART + f"SELECT doc_id, trim(content, {_WS}) AS content FROM articles",
    "f11_join_lines": _ART
    + f"SELECT doc_id, {_joined_lines('content')} AS joined, lower(url) AS lowered, "
    "true AS opens, url AS address FROM articles",
    "f12_flatten": _ART
    + "SELECT word, count(*) AS n FROM (SELECT unnest(flatten(list_transform("
    "string_split(content, chr(10)), lambda x: string_split(x, ' ')))) AS word FROM articles) GROUP BY word",
    "f13_sentences": _ART
    + rf", cut AS (SELECT doc_id, string_split(regexp_replace(content, '([.!?])[{_RE_WS}]+', "
    r"'\1' || chr(1), 'g'), chr(1)) AS l FROM articles) "
    "SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS sentence FROM cut",
    "f13_stop_statistics": _ART
    + rf""", cut AS (
  SELECT doc_id, list_filter(string_split_regex(content, '[{_RE_WS}]+'), lambda x: x <> '') AS l FROM articles),
told AS (
  SELECT unnest(l) AS token, generate_subscripts(l, 1) AS i, l, len(l) AS n FROM cut),
facts AS (
  SELECT regexp_replace(regexp_replace(lower(token), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g'), '\.$', '') AS word,
    ends_with(token, '.') AS stop, regexp_matches(l[i + 1], '^[^\p{{L}}\p{{N}}]*[\p{{Ll}}\p{{N}}]') AS small
  FROM told WHERE i < n)
SELECT word, count(*) FILTER (WHERE stop) AS with_stop, count(*) FILTER (WHERE NOT stop) AS without,
  count(*) FILTER (WHERE stop AND small) AS before_lower
FROM facts WHERE word <> '' GROUP BY word HAVING count(*) FILTER (WHERE stop) >= 3""",
    "e1_article_table": with_(ARTICLES_CTE, _DUMP_CTE)
    + f"SELECT {_DAY} AS date, {_CATEGORY} AS news_category, {_HEADLINE} AS headline, "
    f"{_joined_lines('body')} AS content, url FROM dump",
}

ORACLES["s2_segment_all_lines"] = ORACLES["s2_segment_lines"].replace(" AND article_no < n", "")
