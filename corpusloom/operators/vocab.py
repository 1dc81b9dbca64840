"""Term statistics, bounded vocabularies and term vectors."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import tokens as K
from corpusloom.operators.lookups import lookup_join
from corpusloom.session import fits_inline, lookup_size, write_scratch

# A document has some thousands of distinct terms on average, so this share bounds a vocabulary to some
# millions of terms, whatever the corpus.
SMALLEST_SHARE = 1e-4

_ORDERS = {
    "cf": lambda: [F.desc("cf"), F.col("term")],
    "df": lambda: [F.desc("df"), F.col("term")],
    "alphabetical": lambda: [F.col("term")],
}


def term_counts(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """``(key, term, tf)``, counted inside each row without a shuffle."""
    return docs.select(key, F.inline(K.count_terms(tokens)))


def term_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(term, df, cf)``: documents with the term, occurrences of the term.

    The only shuffle is by term and carries partial sums, so frequent terms do no harm.
    """
    return (
        docs.select(F.inline(K.count_terms(tokens)))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    )


def doc_count(docs: DataFrame) -> Column:
    """The number of documents as a scalar subquery."""
    return docs.agg(F.count(F.lit(1)).alias("n")).scalar()


def build_vocab(
    docs: DataFrame,
    min_df_frac: float | None = None,
    max_df_frac: float | None = None,
    min_df_count: float | None = None,
    max_df_count: float | None = None,
    size: int | None = None,
    order: str = "cf",
    tokens: str = "tokens",
    n_docs: int | None = None,
) -> DataFrame:
    """``(term_id, term, df, cf)`` of the terms within the given inclusive bounds.

    ``order`` numbers the terms: by corpus or document frequency, largest first and ties by term,
    or alphabetically. ``size`` cuts the list; it goes by document frequency for ``"df"`` and by
    corpus frequency otherwise. Either ``size`` or ``min_df_frac`` must be set: both keep the
    vocabulary from growing with the corpus, since only so many terms can each occur in a fixed
    share of the documents.
    """
    _check_bound(size, min_df_frac)
    total = F.lit(n_docs) if n_docs is not None else doc_count(docs)
    return vocab_of(
        term_stats(docs, tokens), total, min_df_frac, max_df_frac, min_df_count, max_df_count, size, order
    )


def _check_bound(size: int | None, min_df_frac: float | None) -> None:
    if size is None and (min_df_frac or 0) < SMALLEST_SHARE:
        raise ValueError(f"give size or a min_df_frac of at least {SMALLEST_SHARE}, else the vocabulary grows with the corpus")


def vocab_of(
    stats: DataFrame,
    total: Column,
    min_df_frac: float | None = None,
    max_df_frac: float | None = None,
    min_df_count: float | None = None,
    max_df_count: float | None = None,
    size: int | None = None,
    order: str = "cf",
) -> DataFrame:
    """``build_vocab`` from the statistics ``(term, df, cf)`` of ``total`` documents."""
    _check_bound(size, min_df_frac)
    df = F.col("df")
    if min_df_count is not None:
        stats = stats.filter(df >= F.lit(float(min_df_count)))
    if max_df_count is not None:
        stats = stats.filter(df <= F.lit(float(max_df_count)))
    if min_df_frac is not None:
        stats = stats.filter(df >= F.lit(float(min_df_frac)) * total)
    if max_df_frac is not None:
        stats = stats.filter(df <= F.lit(float(max_df_frac)) * total)
    if size is not None:
        ranked = "df" if order == "df" else "cf"
        stats = _near_the_top(stats, ranked, size)
        stats = stats.orderBy(*_ORDERS[ranked]()).limit(size)
    # At most a bounded number of rows is left, so one task may number them.
    number = F.row_number().over(W.orderBy(*_ORDERS[order]())) - 1
    return stats.select(number.alias("term_id"), "term", "df", "cf")


def _near_the_top(stats: DataFrame, column: str, size: int) -> DataFrame:
    """Terms that can be among the ``size`` largest.

    There may be billions of rare terms, and taking the top of every
    partition to one task would gather far more than ``size`` rows. The histogram of the ranking
    column is small and tells from which value on the top is complete. The statistics are written
    out first, so that the texts are read once for both steps.
    """
    stats = write_scratch(stats, "term-stats")
    histogram = stats.groupBy(column).agg(F.count(F.lit(1)).alias("terms"))
    so_far = F.sum("terms").over(W.orderBy(F.desc(column)))
    cutoff = (
        histogram.select(column, so_far.alias("so_far"))
        .filter(F.col("so_far") >= size)
        .agg(F.max(column))
        .scalar()
    )
    return stats.filter(F.col(column) >= F.coalesce(cutoff, F.lit(0)))


def bag_of_words(
    docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", key: str = "doc_id"
) -> DataFrame:
    """``(key, term_id, tf)``; terms outside the vocabulary are left out."""
    counts = term_counts(docs, tokens, key)
    return lookup_join(counts, vocab.select("term", "term_id"), "term", "inner").select(key, "term_id", "tf")


def tf_idf(counts: DataFrame, vocab: DataFrame, n_docs: int | Column) -> DataFrame:
    """Add ``idf = ln((N + 1) / (df + 1))`` and ``tf_idf`` to ``(…, term_id, tf)``."""
    total = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    idf = F.ln((total + 1) / (F.col("df") + 1))
    weights = vocab.select("term_id", idf.alias("idf"))
    return lookup_join(counts, weights, "term_id", "inner").withColumn("tf_idf", F.col("tf") * F.col("idf"))


def terms_in_order(vocab: DataFrame) -> list[str]:
    """The vocabulary as a list for Spark ML models, which keep it on the driver."""
    return [row["term"] for row in vocab.select("term_id", "term").orderBy("term_id").collect()]


def vectorizer(terms: list[str], tokens: str = "tokens", out: str = "features") -> CountVectorizerModel:
    """A Spark ML transformer that counts the given terms; building it sends them to the JVM once."""
    return CountVectorizerModel.from_vocabulary(terms, inputCol=tokens, outputCol=out, minTF=1.0)


def vectorize(
    docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", out: str = "features", key: str = "doc_id"
) -> DataFrame:
    """Add sparse term counts as a Spark ML vector, indexed by ``term_id`` from 0 on.

    A vocabulary within the inline limits becomes a Spark ML model. A larger one never reaches the
    driver: the counts are joined with it and each row's vector is put together from its term ids.
    Both give the same vectors; a row without known terms, or with null tokens, has an empty one.
    """
    rows, size = lookup_size(vocab.select("term_id", "term"))
    if fits_inline(rows, size):
        # The model takes no null for tokens.
        known = docs.withColumn("__tokens", F.coalesce(F.array_compact(F.col(tokens)), F.array().cast("array<string>")))
        return vectorizer(terms_in_order(vocab), "__tokens", out).transform(known).drop("__tokens")
    return assemble_vectors(docs, vocab, rows, tokens, out, key)


def assemble_vectors(docs: DataFrame, vocab: DataFrame, size: int, tokens: str, out: str, key: str) -> DataFrame:
    """``vectorize`` by joining; ``size`` is the number of terms.

    Rows are told apart by key and tokens, as equal ones have equal vectors.
    """
    marked = docs.withColumn("__row", F.struct(F.col(key), F.xxhash64(tokens)))
    once = marked.select("__row", F.array_compact(F.col(tokens)).alias("__tokens")).dropDuplicates(["__row"])
    cells = bag_of_words(once, vocab, "__tokens", "__row")
    lists = cells.groupBy(F.col("__row").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("term_id", "tf"))).alias("__cells"))
    joined = marked.join(lists, F.col("__row").eqNullSafe(F.col("__key")), "left")
    held = F.coalesce("__cells", F.array().cast("array<struct<term_id:int,tf:bigint>>"))
    parts = F.struct(
        F.lit(0).alias("type"),
        F.lit(size).alias("size"),
        F.transform(held, lambda c: c["term_id"]).alias("indices"),
        F.transform(held, lambda c: c["tf"].cast("double")).alias("values"),
    )
    # The parser builds a vector from its written parts; there is no cast that does.
    vector = F.from_json(F.to_json(F.struct(parts.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))
    return joined.withColumn(out, vector["v"]).drop("__row", "__key", "__cells")
