"""Queries over the corpus profile, vocabularies and term vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.operators import profile as P
from corpusloom.operators import vocab as V
from corpusloom.operators.clean import describe_urls
from corpusloom.operators.lookups import name_terms
from corpusloom.operators.termstats import batch_stats, documents_of, read_stats, terms_of, write_batch
from corpusloom.operators.tokens import preprocess
from corpusloom.operators.wordlists import invert_lemmas
from corpusloom.queries import cleaning
from corpusloom.queries import inputs as I
from corpusloom.queries.inputs import ALL, ARTICLES_CTE, LEMMAS, STATS_CTE, TOK_CTE, with_
from corpusloom.queries.words import _KEPT_CTE, _LEMMA_CTE
from corpusloom.session import scratch_path, write_scratch

_TOP_WORDS_SIZE = 10_000
_TRIAL_ROWS = 2_000
_TRIAL_ROWS_INCLUSIVE = 2_001


def _described(spark, sf_dir):
    return describe_urls(I.urls(spark, sf_dir))


def _ranked(counts, ascending=False):
    """Counts with their place; only for lists cut to a fixed length."""
    order = [F.col("n") if ascending else F.desc("n"), F.col("news_category")]
    place = F.row_number().over(W.orderBy(*order)).cast("bigint")
    return counts.select(place.alias("place"), "news_category", "n")


def a1_count_articles(spark, sf_dir):
    return P.corpus_profile(_described(spark, sf_dir)).select("articles")


def a2_count_categories(spark, sf_dir):
    return P.corpus_profile(_described(spark, sf_dir)).select("articles", "categories")


def a3_date_range(spark, sf_dir):
    profile = P.corpus_profile(_described(spark, sf_dir))
    return profile.select(
        F.col("first_date").cast("string").alias("first_date"),
        F.col("last_date").cast("string").alias("last_date"),
    )


def a4_top_categories(spark, sf_dir):
    return _ranked(P.value_counts(_described(spark, sf_dir), "news_category", top=5))


def a5_thirty_categories(spark, sf_dir):
    counts = P.value_counts(_described(spark, sf_dir), "news_category", top=30, ascending=True)
    return _ranked(counts, ascending=True)


def a6_categories_of_first_rows(spark, sf_dir):
    first = P.first_rows(_described(spark, sf_dir), _TRIAL_ROWS_INCLUSIVE)
    return _ranked(P.value_counts(first, "news_category", top=15, ascending=True), ascending=True)


def a7_group_forms(spark, sf_dir):
    inverted = invert_lemmas(I.lemma_lookup(spark, sf_dir))
    return inverted.select("lemma", F.size("forms").cast("bigint").alias("n_forms"))


def a8_term_counts(spark, sf_dir):
    return V.term_counts(I.tokens(spark, sf_dir))


def a9_term_stats(spark, sf_dir):
    return V.term_stats(I.tokens(spark, sf_dir))


def o1_first_documents(spark, sf_dir):
    first = P.first_rows(I.table(spark, sf_dir, "documents"), _TRIAL_ROWS)
    return first.select("doc_id", "lang", "source", "text")


def o2_head_and_tail(spark, sf_dir):
    rows = _described(spark, sf_dir).select("doc_id", "news_category", "headline")
    head = P.first_rows(rows, 5).withColumn("part", F.lit("head"))
    return head.unionByName(P.last_rows(rows, 5).withColumn("part", F.lit("tail")))


def o3_categories_ascending(spark, sf_dir):
    return P.value_counts(_described(spark, sf_dir), "news_category", ascending=True)


def _term_id():
    return F.col("term_id").cast("bigint").alias("term_id")


def v1_count_vectors(spark, sf_dir):
    """Spark ML vectors over the bounded vocabulary, read back as rows."""
    docs = I.tokens(spark, sf_dir)
    vocab = write_scratch(
        V.build_vocab(docs, min_df_frac=0.02, max_df_frac=0.8, size=_TOP_WORDS_SIZE), "vocab"
    )
    vectors = V.vectorize(docs, vocab)
    sparse = vectors.select("doc_id", F.unwrap_udt("features").alias("v"))
    cells = sparse.select(
        "doc_id", F.inline(F.arrays_zip(F.col("v.indices").alias("term_id"), F.col("v.values").alias("tf")))
    )
    return name_terms(cells, vocab).select("doc_id", "term", F.col("tf").cast("bigint"))


def v2_vocabulary(spark, sf_dir):
    vocab = V.build_vocab(
        I.tokens(spark, sf_dir), min_df_frac=0.02, max_df_frac=0.8, size=_TOP_WORDS_SIZE
    )
    return vocab.select(_term_id(), "term", "df", "cf")


def v3_alphabetical_vocabulary(spark, sf_dir):
    """Words of two or more characters in letters of any script."""
    docs = I.documents(spark, sf_dir).select(K.tokenize("text", K.WORD_PATTERN).alias("tokens"))
    vocab = V.build_vocab(docs, min_df_frac=0.02, max_df_frac=0.5, order="alphabetical")
    return vocab.select(_term_id(), "term", "df", "cf")


def v4_dictionary(spark, sf_dir):
    """At most 100,000 terms by document frequency; the lower bound is a count of documents."""
    vocab = V.build_vocab(
        I.tokens(spark, sf_dir), min_df_count=0.02, max_df_frac=0.8, size=100_000, order="df"
    )
    return vocab.select(_term_id(), "term", "df", "cf")


def v5_bag_of_words(spark, sf_dir):
    docs = I.tokens(spark, sf_dir)
    vocab = V.build_vocab(docs, min_df_count=0.02, max_df_frac=0.8, size=100_000, order="df")
    bags = V.bag_of_words(docs, write_scratch(vocab, "vocab"))
    return bags.select("doc_id", _term_id(), "tf")


def v6_tf_idf(spark, sf_dir):
    docs = I.tokens(spark, sf_dir)
    vocab = write_scratch(
        V.build_vocab(docs, min_df_frac=0.02, max_df_frac=0.8, size=_TOP_WORDS_SIZE), "vocab"
    )
    weighted = V.tf_idf(V.bag_of_words(docs, vocab), vocab, V.doc_count(docs))
    return name_terms(weighted, vocab).select(
        "doc_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("tf_idf", 6).alias("tf_idf")
    )


def e2_lemma_vocabulary(spark, sf_dir):
    """Text to vocabulary in one go: tokens, stopwords, lemmas, frequency bounds."""
    docs = preprocess(
        I.documents(spark, sf_dir),
        I.stopwords(spark, sf_dir),
        I.lemma_lookup(spark, sf_dir),
        text="text",
    )
    vocab = V.build_vocab(docs, min_df_frac=0.02, max_df_frac=0.8, size=_TOP_WORDS_SIZE)
    return vocab.select(_term_id(), "term", "df", "cf")


def a9_merged_stats(spark, sf_dir):
    """The statistics of three batches of the documents, added up, with the row of totals."""
    docs = I.tokens(spark, sf_dir)
    path = scratch_path(spark, "batches")
    for batch in range(3):
        write_batch(batch_stats(docs.filter(F.pmod("doc_id", F.lit(3)) == batch)), path, f"b{batch}")
    return read_stats(spark, path)


def v2_vocabulary_of_stats(spark, sf_dir):
    """The vocabulary from the table of term statistics, without reading the texts again."""
    stats = I.term_table(spark, sf_dir)
    vocab = V.vocab_of(terms_of(stats), documents_of(stats), min_df_frac=0.02, max_df_frac=0.8, size=_TOP_WORDS_SIZE)
    return vocab.select(_term_id(), "term", "df", "cf")


QUERIES = {
    q.__name__: q
    for q in (
        a1_count_articles, a2_count_categories, a3_date_range, a4_top_categories,
        a5_thirty_categories, a6_categories_of_first_rows, a7_group_forms, a8_term_counts,
        a9_term_stats, a9_merged_stats, v2_vocabulary_of_stats, o1_first_documents, o2_head_and_tail, o3_categories_ascending,
        v1_count_vectors, v2_vocabulary, v3_alphabetical_vocabulary, v4_dictionary,
        v5_bag_of_words, v6_tf_idf, e2_lemma_vocabulary,
    )
}

_DESCRIBED = with_(
    ARTICLES_CTE,
    f"described AS (SELECT doc_id, {cleaning._DAY} AS date, {cleaning._CATEGORY} AS news_category, "
    f"{cleaning._HEADLINE} AS headline FROM articles)",
)
_N_DOCS = "(SELECT count(*) FROM documents)"


def _bounds(low: float | None, high: float) -> str:
    upper = f"df <= CAST({high} AS DOUBLE) * {_N_DOCS}"
    return upper if low is None else f"df >= CAST({low} AS DOUBLE) * {_N_DOCS} AND {upper}"


def _vocab(order: str, bounds: str, limit: int | None = None, stats: str = "stats") -> str:
    cut = "" if limit is None else f" ORDER BY term_id LIMIT {limit}"
    return (
        f"vocab AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS term_id, term, df, cf "
        f"FROM {stats} WHERE {bounds}{cut})"
    )


_BY_CF = _vocab("cf DESC, term", _bounds(0.02, 0.8), _TOP_WORDS_SIZE)
_BY_DF = _vocab("df DESC, term", _bounds(None, 0.8), 100_000)
_TERMS = with_(TOK_CTE, STATS_CTE, _BY_CF)
_COUNTS = "SELECT doc_id, term_id, term, df, count(*) AS tf FROM tok JOIN vocab ON term = token GROUP BY ALL"
_BY_CATEGORY = "SELECT news_category, count(*) AS n FROM {0} WHERE news_category IS NOT NULL GROUP BY 1"


def _categories(source: str, top: int, final: str) -> str:
    return (
        f"SELECT row_number() OVER (ORDER BY {final}, news_category) AS place, news_category, n "
        f"FROM ({_BY_CATEGORY.format(source)} ORDER BY n DESC, news_category LIMIT {top})"
    )


ORACLES = {
    "a1_count_articles": "SELECT count(*) AS articles FROM documents",
    "a2_count_categories": _DESCRIBED
    + "SELECT count(*) AS articles, count(DISTINCT news_category) AS categories FROM described",
    "a3_date_range": _DESCRIBED + "SELECT min(date) AS first_date, max(date) AS last_date FROM described",
    "a4_top_categories": _DESCRIBED + _categories("described", 5, "n DESC"),
    "a5_thirty_categories": _DESCRIBED + _categories("described", 30, "n"),
    "a6_categories_of_first_rows": _DESCRIBED
    + _categories(f"(SELECT * FROM described ORDER BY doc_id LIMIT {_TRIAL_ROWS_INCLUSIVE})", 15, "n"),
    "a7_group_forms": with_(*LEMMAS) + "SELECT lemma, count(*) AS n_forms FROM lemmas GROUP BY lemma",
    "a8_term_counts": with_(TOK_CTE) + "SELECT doc_id, token AS term, count(*) AS tf FROM tok GROUP BY ALL",
    "a9_merged_stats": with_(TOK_CTE, STATS_CTE)
    + "SELECT term, df, cf FROM stats UNION ALL SELECT NULL, (SELECT count(*) FROM documents), (SELECT count(*) FROM tok)",
    "a9_term_stats": with_(TOK_CTE, STATS_CTE) + "SELECT term, df, cf FROM stats",
    "o1_first_documents": f"SELECT doc_id, lang, source, text FROM documents ORDER BY doc_id LIMIT {_TRIAL_ROWS}",
    "o2_head_and_tail": _DESCRIBED
    + "SELECT doc_id, news_category, headline, 'head' AS part FROM (FROM described ORDER BY doc_id LIMIT 5) "
    "UNION ALL SELECT doc_id, news_category, headline, 'tail' FROM (FROM described ORDER BY doc_id DESC LIMIT 5)",
    "o3_categories_ascending": _DESCRIBED + _BY_CATEGORY.format("described"),
    "v1_count_vectors": _TERMS + f"SELECT doc_id, term, tf FROM ({_COUNTS})",
    "v2_vocabulary_of_stats": _TERMS + "SELECT term_id, term, df, cf FROM vocab",
    "v2_vocabulary": _TERMS + "SELECT term_id, term, df, cf FROM vocab",
    "v3_alphabetical_vocabulary": with_(
        r"toklist AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS l FROM documents)",
        "tok AS (SELECT doc_id, unnest(l) AS token FROM toklist)",
        STATS_CTE,
        _vocab("term", _bounds(0.02, 0.5)),
    )
    + "SELECT term_id, term, df, cf FROM vocab",
    "v4_dictionary": with_(TOK_CTE, STATS_CTE, _BY_DF) + "SELECT term_id, term, df, cf FROM vocab",
    "v5_bag_of_words": with_(TOK_CTE, STATS_CTE, _BY_DF) + f"SELECT doc_id, term_id, tf FROM ({_COUNTS})",
    "v6_tf_idf": _TERMS
    + f"SELECT doc_id, term, tf, round(ln(({_N_DOCS} + 1) / (df + 1)), 6) AS idf, "
    f"round(tf * ln(({_N_DOCS} + 1) / (df + 1)), 6) AS tf_idf FROM ({_COUNTS})",
    "e2_lemma_vocabulary": with_(
        *ALL,
        _KEPT_CTE,
        _LEMMA_CTE,
        "lemma_stats AS (SELECT lemma AS term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM lem GROUP BY lemma)",
        _vocab("cf DESC, term", _bounds(0.02, 0.8), _TOP_WORDS_SIZE, "lemma_stats"),
    )
    + "SELECT term_id, term, df, cf FROM vocab",
}
