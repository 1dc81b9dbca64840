"""Stopword files and lemma dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.positions import read_positioned
from corpusloom.sources.quoted import quote_count, read_quoted


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lines of a word file as ``(word)``."""
    return spark.read.text(path).select(F.col("value").alias("word")).distinct()


def write_stopwords(words: DataFrame, path: str) -> None:
    """Write distinct words in code-point order, one per line.

    The order holds across part files; a list of usual size makes a single one.
    """
    words.select("word").distinct().orderBy("word").write.text(path)


def read_lemma_json(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """A form-to-lemma lookup as ``(position, form, lemma)``; the last entry of a form wins.

    The file is one JSON object of texts, or one object per line with ``json_lines``. A large file
    is read by many tasks either way: an object is cut at its commas, those within texts apart.
    """
    records = read_positioned(spark, path) if json_lines else _object_entries(spark, path)
    entries = records.select(
        "file",
        "position",
        F.posexplode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias(
            "entry", "form", "lemma"
        ),
    )
    order = F.struct("file", "position", "entry")
    return entries.groupBy("form").agg(
        F.min(order).alias("position"), F.max_by("lemma", order).alias("lemma")
    ).select("position", "form", "lemma")


def _object_entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of one JSON object a file, each as an object of its own ``(file, position, value)``."""
    # Escapes occur within texts only, and no comma is escaped.
    odd = quote_count(F.regexp_replace("value", r"(?s)\\.", "")) % 2 == 1
    entries = read_quoted(spark, path, ",", outside=odd, inside=~odd)
    bare = F.regexp_replace("value", r"\A\s*\{|\}\s*\z", "")
    return entries.select("file", F.col("number").alias("position"), F.concat(F.lit("{"), bare, F.lit("}")).alias("value"))


def write_lemma_objects(lookup: DataFrame, path: str, size: int = 10_000) -> None:
    """Write ``(form, lemma)`` as JSON objects of about ``size`` entries, one per line.

    Entries are dealt to objects by a hash of the form, so that no object grows with the table.
    """
    objects = lookup.count() // size + 1
    number = F.pmod(F.xxhash64("form"), F.lit(objects))
    entries = F.map_from_entries(F.collect_list(F.struct("form", "lemma")))
    lookup.groupBy(number.alias("number")).agg(F.to_json(entries).alias("value")).select("value").write.text(path)


def lemma_lines(inverted: DataFrame) -> DataFrame:
    """``lemma -> lemma form form …`` lines from an inverted lookup, as ``(lemma, line)``."""
    line = F.concat_ws(" ", F.col("lemma"), F.lit("->"), F.col("lemma"), F.array_join("forms", " "))
    return inverted.select("lemma", line.alias("line"))


def write_lemma_dict(inverted: DataFrame, path: str) -> None:
    """Write an inverted lookup as text, in its own order if it has a ``position``."""
    order = "position" if "position" in inverted.columns else "lemma"
    lines = inverted.orderBy(order).transform(lemma_lines)
    lines.select("line").write.text(path)


def read_lemma_dict(spark: SparkSession, path: str) -> DataFrame:
    """``(form, lemma)`` from a dictionary file; the last line naming a form wins."""
    parts = F.split("value", "->")
    lines = read_positioned(spark, path).select(
        F.struct("file", "position").alias("at"),
        F.trim(F.element_at(parts, 1)).alias("lemma"),
        F.explode(F.split(F.trim(F.get(parts, F.lit(1))), r"\s+")).alias("form"),
    )
    return (
        lines.filter("form != ''")
        .groupBy("form")
        .agg(F.max_by("lemma", "at").alias("lemma"))
    )
