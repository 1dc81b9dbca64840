"""Lookups as joins between exploded tokens and word tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.session import fits_broadcast, lookup_size, write_scratch

HEAVY = 1000  # a word with this part of all tokens, or more, is frequent
TRACKED = 10_000  # words a frequency sketch keeps


def explode_tokens(docs: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """``(key, pos, token)`` with one row per token.

    Spark derives a test for non-empty arrays from a plain ``posexplode`` of a column and pushes
    it towards the scan, where the tokens would be computed a second time. It does not for the
    outer form, whose rows without a token are dropped here.
    """
    exploded = docs.select(key, F.posexplode_outer(tokens).alias("pos", "token"))
    return exploded.filter(F.col("pos").isNotNull())


def collect_tokens(
    tokens: DataFrame, docs: DataFrame, out: str = "tokens", key: str = "doc_id"
) -> DataFrame:
    """Put exploded tokens back in order beside their documents; no tokens give an empty array."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "token")))
    lists = tokens.groupBy(key).agg(F.transform(ordered, lambda row: row["token"]).alias(out))
    others = docs.drop(out)
    empty = F.array().cast("array<string>")
    return others.join(lists, key, "left").withColumn(out, F.coalesce(F.col(out), empty))


def rewrite_tokens(
    docs: DataFrame, lookup: DataFrame, tokens: str, out: str, key: str = "doc_id", lower: bool = False
) -> DataFrame:
    """``docs`` with ``out``: their ``tokens``, those in ``lookup(form, lemma)`` replaced, or dropped
    where the lemma is null. ``lookup`` has one row a form; with ``lower`` tokens are lower-cased to be
    looked up.

    Only tokens that may have an entry leave their row. A Bloom filter of the forms keeps the others;
    so few words are frequent that their entries are written into the expression. What is left
    is joined by a shuffle that no word dominates.

    Rows are told apart by key and tokens. Those that agree in both have the same result, so it is
    computed once, and rows of one key with different tokens keep apart; so do rows without a key.
    """
    lookup = write_scratch(lookup.select("form", "lemma"), "lookup")
    rows, size = lookup_size(lookup)
    if not rows:
        return docs.withColumn(out, F.col(tokens))
    form = F.lower if lower else (lambda token: token)
    heavy = heavy_values(docs.select(F.explode_outer(tokens).alias("token")).select(form(F.col("token")).alias("token")), "token")
    often = lookup.filter(F.col("form").isin(heavy)).collect()  # HEAVY rows at most
    dropped = [r["form"] for r in often if r["lemma"] is None]
    entries = docs.sparkSession.createDataFrame([tuple(r) for r in often if r["lemma"] is not None], "form string, lemma string")
    inline = K.InlineLookup(entries, "form", "lemma", len(often))
    held = K.FormFilter(lookup, "form", rows)
    leaves = lambda t, i: F.coalesce(F.get("__may", i) & ~form(t).isin(heavy), F.lit(False))
    stays = lambda t: F.when(~F.coalesce(form(t).isin(dropped), F.lit(False)), F.coalesce(inline.get(form(t)), t))
    marked = docs.withColumn("__may", held.may_hold_each(F.transform(tokens, form))).withColumns(
        {
            "__row": F.struct(F.col(key), F.xxhash64(tokens)),
            "__parts": F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), t.alias("token"), leaves(t, i).alias("leaves"))),
        }
    ).drop("__may")
    leaving = marked.select("__row", F.filter("__parts", lambda p: p["leaves"]).alias("__parts")).filter(F.size("__parts") > 0)
    tokens_ = leaving.dropDuplicates(["__row"]).select("__row", F.explode("__parts").alias("p"))
    tokens_ = tokens_.select("__row", "p.pos", "p.token", form(F.col("p.token")).alias("form"))
    known = lookup.withColumn("known", F.lit(True))
    known = F.broadcast(known) if fits_broadcast(rows, size) else known
    found = tokens_.join(known, "form", "left").select(
        "__row", "pos", F.when(F.col("known"), F.col("lemma")).otherwise(F.col("token")).alias("token")
    )
    lists = found.filter("token is not null").groupBy(F.col("__row").alias("__key")).agg(
        F.collect_list(F.struct("pos", "token")).alias("__back")
    )
    closed = F.transform(
        F.filter("__parts", lambda p: ~p["leaves"]), lambda p: F.struct(p["pos"].alias("pos"), stays(p["token"]).alias("token"))
    )
    none = F.array().cast("array<struct<pos:int,token:string>>")
    merged = F.sort_array(F.concat(F.filter(closed, lambda p: p["token"].isNotNull()), F.coalesce("__back", none)))
    joined = marked.join(lists, F.col("__row").eqNullSafe(F.col("__key")), "left")
    return joined.withColumn(out, F.transform(merged, lambda p: p["token"])).drop("__row", "__key", "__back", "__parts")


def one_lemma(lemmas: DataFrame) -> DataFrame:
    """``(form, lemma)`` with one row per form: the smallest of its lemmas; nulls are left out."""
    known = lemmas.filter("form is not null and lemma is not null")
    return known.groupBy("form").agg(F.min("lemma").alias("lemma"))


def heavy_values(rows: DataFrame, on: str) -> list:
    """The values of ``on`` that make up one in ``HEAVY`` of all rows or more, from a frequency sketch.

    The sketch tracks ``TRACKED`` values whatever the number of rows, and errs by less than one in
    ``HEAVY`` of them, so it holds every such value. A value named beside them does no harm.
    """
    top = rows.agg(F.expr(f"approx_top_k(`{on}`, {HEAVY}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [item["item"] for item in top["top"] or [] if item["item"] is not None and item["count"] * HEAVY >= top["n"]]


def lookup_join(tokens: DataFrame, lookup: DataFrame, on: str, how: str) -> DataFrame:
    """Join tokens with a word table that has one row per ``on``; ``how`` keeps or drops tokens.

    A table within the broadcast limits is sent to the tokens. Beyond them the rows of the
    few words that a sketch finds to be frequent, ``HEAVY`` at most, are sent, since a single word can
    make up a third of all tokens; the others are joined by one shuffle, as they are.
    """
    if fits_broadcast(*lookup_size(lookup)):
        return tokens.join(F.broadcast(lookup), on, how)
    heavy = heavy_values(tokens, on)
    if not heavy:
        return tokens.join(lookup, on, how)
    often = F.coalesce(F.col(on).isin(heavy), F.lit(False))
    known = F.broadcast(lookup.filter(F.col(on).isin(heavy)))
    return tokens.filter(often).join(known, on, how).unionByName(tokens.filter(~often).join(lookup, on, how))


def drop_words(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens not among ``words``, whatever the case."""
    listed = words.filter("word is not null").select(F.lower("word").alias("lowered")).distinct()
    lowered = tokens.withColumn("lowered", F.lower("token"))
    return lookup_join(lowered, listed, "lowered", "left_anti").drop("lowered")


def map_lemmas(tokens: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Each token replaced by its lemma; tokens without one stay as they are."""
    forms = one_lemma(lemmas).select(F.col("form").alias("token"), "lemma")
    return (
        lookup_join(tokens, forms, "token", "left")
        .withColumn("token", F.coalesce("lemma", "token"))
        .select(*tokens.columns)
    )


def name_terms(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``term`` to rows that carry a ``term_id``."""
    return lookup_join(rows, vocab.select("term_id", "term"), "term_id", "inner")


def forms_of(roots: DataFrame, lookup: DataFrame) -> DataFrame:
    """``(root, form)`` for every form whose lemma is one of the roots ``(word)``."""
    named = roots.select(F.col("word").alias("lemma")).distinct()
    return lookup_join(lookup.select("lemma", "form"), named, "lemma", "inner").select(
        F.col("lemma").alias("root"), "form"
    )


def known_terms(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Rows whose ``term`` is in the vocabulary."""
    return lookup_join(counts, vocab.select("term"), "term", "left_semi")
