"""Building stopword and lemma tables."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions.tokens import ALPHABETIC
from corpusloom.operators.lookups import forms_of


def invert_lemmas(lookup: DataFrame) -> DataFrame:
    """``(lemma, forms)`` from ``(form, lemma)``, plus ``position`` if the lookup has one.

    Forms keep the lookup's order, or are sorted where it has none.
    """
    if "position" in lookup.columns:
        forms = F.sort_array(F.collect_list(F.struct("position", "form")))
        return lookup.groupBy("lemma").agg(
            F.min("position").alias("position"),
            F.transform(forms, lambda row: row["form"]).alias("forms"),
        )
    return lookup.groupBy("lemma").agg(F.sort_array(F.collect_list("form")).alias("forms"))


def alphabetic_lemmas(inverted: DataFrame) -> DataFrame:
    """Lower-cased lemmas and forms made of letters only."""
    letters = F.filter("forms", lambda form: form.rlike(ALPHABETIC))
    return inverted.filter(F.col("lemma").rlike(ALPHABETIC)).withColumns(
        {"lemma": F.lower("lemma"), "forms": F.transform(letters, F.lower)}
    )


def flatten_lemmas(inverted: DataFrame) -> DataFrame:
    """Back to ``(form, lemma)``, each lemma being a form of itself.

    Lower-casing can give a form two lemmas; the later entry wins, as it would in a file.
    """
    order = F.col("position") if "position" in inverted.columns else F.col("lemma")
    forms = inverted.select(
        order.alias("at"),
        "lemma",
        F.explode(F.concat(F.array("lemma"), "forms")).alias("form"),
    )
    return forms.groupBy("form").agg(F.max_by("lemma", "at").alias("lemma"))


def combine_words(*lists: DataFrame) -> DataFrame:
    """All words of all lists, repeated ones included."""
    return reduce(DataFrame.unionByName, (words.select("word") for words in lists))


def word_classes(spark: SparkSession) -> DataFrame:
    """The configured classes of domain words as ``(class, word)``."""
    rows = [(name, word) for name, words in C.WORD_CLASSES.items() for word in words]
    return spark.createDataFrame(rows, "class string, word string")


def light_verb_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in C.LIGHT_VERB_ROOTS], "word string")


def base_stopwords(spark: SparkSession, language: str = "english") -> DataFrame:
    """Spark's own stopword list, used where no other base list is given."""
    words = StopWordsRemover.loadDefaultStopWords(language)
    return spark.createDataFrame([(w,) for w in words], "word string")


def expand_roots(roots: DataFrame, lookup: DataFrame) -> DataFrame:
    """Every form of the root words, and the roots themselves, as ``(word)``."""
    forms = forms_of(roots, lookup).select(F.col("form").alias("word"))
    return combine_words(forms, roots)


def build_stopwords(base: DataFrame, classes: DataFrame, verbs: DataFrame) -> DataFrame:
    """The distinct words of a base list, the domain classes and the expanded verbs."""
    return combine_words(base, classes, verbs).distinct()
