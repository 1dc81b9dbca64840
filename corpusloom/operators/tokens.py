"""Tokens, stopwords and lemmas on document tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import tokens as K
from corpusloom.operators import lookups as J
from corpusloom.session import fits_broadcast, fits_inline, lookup_size, write_scratch

# Up to this many words a list is written into the plan as a hash set.
INLINE_WORDS = 10_000


def tokenize(
    docs: DataFrame, text: str = "content", out: str = "words", pattern: str = C.TOKEN_PATTERN
) -> DataFrame:
    """Lower-cased matches of the token pattern."""
    return docs.withColumn(out, K.tokenize(text, pattern))


def clean_text(
    docs: DataFrame, text: str = "content", out: str = "clean", lowercase: bool = True
) -> DataFrame:
    """Matches of the token pattern joined by spaces."""
    return docs.withColumn(out, K.joined_tokens(text, lowercase))


def remove_stopwords(
    docs: DataFrame,
    words: DataFrame | Iterable[str],
    tokens: str = "words",
    out: str = "words_filtered",
    key: str = "doc_id",
    strategy: str = "auto",
) -> DataFrame:
    """Drop stopwords whatever their case; a null word stands for nothing.

    A list of usual size is tested inside each row. Only a word table beyond ``INLINE_WORDS``, or
    any with ``strategy="join"``, is joined to the tokens that may be in it. Both give the same rows.
    """
    if isinstance(words, DataFrame):
        listed = words.filter("word is not null").select(F.lower("word").alias("word")).distinct()
        head = [] if strategy == "join" else listed.limit(INLINE_WORDS + 1).collect()
        if strategy == "join" or len(head) > INLINE_WORDS:
            gone = listed.select(F.col("word").alias("form"), F.lit(None).cast("string").alias("lemma"))
            return J.rewrite_tokens(docs, gone, tokens, out, key, lower=True)
        words = [row["word"] for row in head]
    return docs.withColumn(out, K.without_words(tokens, words))


def remove_words(
    docs: DataFrame,
    words: Iterable[str] = (*C.PUNCTUATION, *C.EXTRA_WORDS),
    tokens: str = "tokens",
    out: str = "tokens",
) -> DataFrame:
    """Drop punctuation marks and a few titles."""
    return docs.withColumn(out, K.without_words(tokens, words))


def join_tokens(docs: DataFrame, tokens: str = "words_filtered", out: str = "words_joined") -> DataFrame:
    return docs.withColumn(out, F.array_join(tokens, " "))


def split_words(docs: DataFrame, text: str = "words_joined", out: str = "tokens") -> DataFrame:
    """Back from joined text to tokens; blank text has none."""
    words = F.split(F.trim(text), r"\s+")
    return docs.withColumn(out, F.filter(words, lambda w: w != ""))


def lemmatize(
    docs: DataFrame,
    lemmas: DataFrame,
    tokens: str = "words_filtered",
    out: str = "tokens",
    key: str = "doc_id",
    strategy: str = "auto",
) -> DataFrame:
    """Replace tokens by their lemmas from ``(form, lemma)``; unknown tokens stay.

    Entries without a form or lemma are left out, and of several lemmas of a form the smallest is
    taken. A dictionary within the inline limits is looked up inside each row, one within the broadcast
    limits in batches of rows. A larger one, or any with ``strategy="join"``, is joined to the tokens
    that may be in it, by a shuffle of those by word and one of the rows. All give the same rows.
    """
    lemmas = write_scratch(J.one_lemma(lemmas), "lemma-table")
    rows, size = lookup_size(lemmas)
    if strategy == "join" or not fits_broadcast(rows, size):
        return J.rewrite_tokens(docs, lemmas, tokens, out, key)
    if not fits_inline(rows, size):
        return docs.withColumn(out, K.replaced_forms(tokens, lemmas))
    table = K.InlineLookup(lemmas, "form", "lemma", rows)
    return docs.withColumn(
        out, F.transform(tokens, lambda token: F.coalesce(table.get(token), token))
    )


def preprocess(
    docs: DataFrame,
    words: DataFrame | Iterable[str],
    lemmas: DataFrame,
    text: str = "content",
    alpha_only: bool = False,
    break_hyphens: bool = False,
    lowercase_lemmas: bool = False,
    key: str = "doc_id",
) -> DataFrame:
    """Text to ``tokens``: match, filter stopwords on the surface form, then look up lemmas.

    Stopwords go before the lookup, so a lemma that is itself a stopword survives. With
    ``alpha_only`` numbers and hyphenated tokens go too, unless hyphens are broken first.
    """
    out = tokenize(docs, text)
    if break_hyphens:
        out = out.withColumn("words", K.split_hyphens("words"))
    if alpha_only:
        out = out.withColumn("words", K.alphabetic_only("words"))
    out = remove_stopwords(out, words, key=key)
    out = lemmatize(out, lemmas, key=key)
    if lowercase_lemmas:
        out = out.withColumn("tokens", F.transform("tokens", F.lower))
    return out.drop("words", "words_filtered")
