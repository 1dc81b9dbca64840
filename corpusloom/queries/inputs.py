"""Inputs of the registered queries, all derived from the given tables.

The documents carry no URL, dateline, em dash, CJK character or underscore. Those cases are added
by expressions on the document key, written once in SQL that both engines understand.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import tokens as K
from corpusloom.operators.termstats import batch_stats, documents_of, terms_of
from corpusloom.operators.wordlists import combine_words, word_classes
from corpusloom.session import spread, write_scratch

URL_SQL = """
CASE doc_id % 50
WHEN 7 THEN 'http://www.example.com/about/' || source || '.html'
WHEN 8 THEN 'http://www.example.com/2015/12/31/old/2016/1/2/' || source || '/a-b-' || CAST(doc_id AS STRING) || '.html'
WHEN 9 THEN 'http://www.example.com/2016/02/03/no-folder-' || lang || '.html'
WHEN 10 THEN 'http://www.example.com/2016/13/45/' || source || '/no-such-day'
WHEN 11 THEN 'http://www.example.com/16/01/02/' || source || '/short-year.html'
ELSE 'http://www.example.com/2016/' || lpad(CAST(1 + doc_id % 6 AS STRING), 2, '0') || '/'
  || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || '/' || source || '/' || lang
  || '/story-of-' || lang || '-no-' || CAST(doc_id AS STRING) || '.html'
END"""

CONTENT_SQL = """
CASE doc_id % 16
WHEN 0 THEN 'WASHINGTON — ' || text
WHEN 1 THEN 'NEW YORK. A b, c. — d — ' || text
WHEN 2 THEN 'Paris, France. — ' || text
WHEN 3 THEN replace(text, ' ', ' _')
WHEN 4 THEN text || ' 한국'
WHEN 5 THEN 'カナ ' || text
WHEN 6 THEN text || ' 中文'
WHEN 7 THEN 'LONDON — ' || text || ' Want to get this briefing by email? Here’s the sign-up. ' || text
WHEN 8 THEN ' \u00a0\u3000 ' || text || '\u2003\u00a0' || chr(10)
WHEN 9 THEN ' \u00a0 '
WHEN 10 THEN '____'
WHEN 11 THEN 'A—' || text
WHEN 12 THEN 'The U.S. said — “' || text || '” — end'
ELSE text
END"""

ARTICLES_CTE = f"articles AS (SELECT doc_id, {URL_SQL} AS url, {CONTENT_SQL} AS content FROM documents)"

# Endings by which a form is traced to a shorter token of the corpus.
SUFFIXES = ("s", "ed", "en", "er", "ing", "tion", "ment")
MIN_STEM = 3
FREQUENT_SHARE = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` spread over the cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, url, content)`` with the cases the documents lack."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return spread(rows, "doc_id").select(
        "doc_id", F.expr(URL_SQL).alias("url"), F.expr(CONTENT_SQL).alias("content")
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, url)``; the texts are not read."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return rows.select("doc_id", F.expr(URL_SQL).alias("url"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, tokens)`` of the documents."""
    return documents(spark, sf_dir).select("doc_id", K.tokenize("text").alias("tokens"))


@lru_cache(maxsize=8)
def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term statistics of the documents, counted once per session: what stopwords, lemmas and
    vocabularies of the queries are drawn from."""
    return write_scratch(batch_stats(tokens(spark, sf_dir)), "term-table")


def frequent_words(spark: SparkSession, sf_dir: str, share: float = FREQUENT_SHARE) -> DataFrame:
    """``(word)`` for terms in at least ``share`` of the documents.

    However large the corpus, only so many terms can each occur in a tenth of it.
    """
    table_ = term_table(spark, sf_dir)
    common = terms_of(table_).filter(F.col("df") >= F.lit(share) * documents_of(table_))
    return common.select(F.col("term").alias("word"))


def stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word)``: the configured classes and the frequent words of the corpus."""
    listed = combine_words(word_classes(spark), frequent_words(spark, sf_dir))
    return write_scratch(listed.distinct(), "stopwords")


def lemma_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(form, lemma)``: tokens traced to their shortest stem in the corpus."""
    terms = terms_of(term_table(spark, sf_dir)).select(F.col("term").alias("form"))
    stems = F.array_compact(
        F.array(
            *(
                F.when(
                    F.endswith("form", F.lit(s)) & (F.length("form") >= len(s) + MIN_STEM),
                    F.substr("form", F.lit(1), F.length("form") - len(s)),
                )
                for s in SUFFIXES
            )
        )
    )
    candidates = terms.select("form", F.explode(stems).alias("lemma"))
    known = terms.select(F.col("form").alias("lemma"))
    lookup = candidates.join(known, "lemma").groupBy("form").agg(
        F.min_by("lemma", F.length("lemma")).alias("lemma")
    )
    return write_scratch(lookup, "lemmas")


# --- The same inputs in SQL. ---

TOKEN_LIST = r"regexp_extract_all(lower(text), '[A-Za-z0-9\-]{3,50}')"

TOK_CTE = (
    "toklist AS MATERIALIZED (SELECT doc_id, " + TOKEN_LIST + " AS l FROM documents), "
    "tok AS (SELECT doc_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM toklist)"
)

STATS_CTE = (
    "stats AS MATERIALIZED (SELECT token AS term, count(DISTINCT doc_id) AS df, count(*) AS cf "
    "FROM tok GROUP BY token)"
)


def words_values(words) -> str:
    return ", ".join("('" + w.replace("'", "''") + "')" for w in words)


CLASSES_CTE = "classes(class, word) AS (VALUES " + ", ".join(
    f"('{name}', '{word}')" for name, words in C.WORD_CLASSES.items() for word in words
) + ")"

FREQUENT_CTE = (
    "frequent AS (SELECT term AS word FROM stats "
    f"WHERE df >= CAST({FREQUENT_SHARE} AS DOUBLE) * (SELECT count(*) FROM documents))"
)

STOPWORDS_CTE = "stop AS (SELECT word FROM classes UNION SELECT word FROM frequent)"

LOOKUP_CTE = (
    "suffixes(s) AS (VALUES " + words_values(SUFFIXES) + "), "
    "lemmas AS MATERIALIZED (SELECT f.term AS form, arg_min(k.term, length(k.term)) AS lemma "
    f"FROM stats f JOIN suffixes ON ends_with(f.term, s) AND length(f.term) >= length(s) + {MIN_STEM} "
    "JOIN stats k ON k.term = left(f.term, length(f.term) - length(s)) GROUP BY f.term)"
)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


WORDS = (TOK_CTE, STATS_CTE, CLASSES_CTE, FREQUENT_CTE, STOPWORDS_CTE)
LEMMAS = (TOK_CTE, STATS_CTE, LOOKUP_CTE)
ALL = (*WORDS, LOOKUP_CTE)
