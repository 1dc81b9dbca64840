"""Sentence ends: abbreviations are learned from the corpus and end no sentence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions import text as X

MOST = 10_000  # abbreviations kept, the most frequent ones

_GAP = f"[{C.WHITESPACE_CLASS}]+"
_EDGE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"
_INITIAL = r"(^|[^\p{L}\p{N}])\p{Lu}\.$"


def _core(token: Column) -> Column:
    """A token lower-cased, without marks around it and without a full stop at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(token), _EDGE, ""), r"\.$", "")


def stop_statistics(docs: DataFrame, text: str = "content") -> DataFrame:
    """``(word, with_stop, without, before_lower)``: how often a word is followed by a full stop
    and white space, how often it is not, and how often a small letter or a digit follows that stop.

    One pass and one shuffle by word, with partial sums.
    """
    tokens = F.filter(F.split(text, _GAP), lambda t: t != "")
    facts = F.transform(
        F.sequence(F.lit(1), F.size("t")),
        lambda i: F.struct(
            _core(F.get("t", i - 1)).alias("word"),
            F.endswith(F.get("t", i - 1), F.lit(".")).alias("stop"),
            F.coalesce(F.get("t", i).rlike(r"^[^\p{L}\p{N}]*[\p{Ll}\p{N}]"), F.lit(False)).alias("lower"),
            (i == F.size("t")).alias("last"),
        ),
    )
    found = docs.select(tokens.alias("t")).filter(F.size("t") > 0).select(F.inline(facts))
    # The last word of a text is followed by nothing and tells nothing.
    return found.filter("word != '' AND NOT last").groupBy("word").agg(
        F.count_if("stop").alias("with_stop"),
        F.count_if(~F.col("stop")).alias("without"),
        F.count_if(F.col("stop") & F.col("lower")).alias("before_lower"),
    )


def abbreviations(statistics: DataFrame, least: int = 5, share: float = 0.9, lower: float = 0.05) -> list[str]:
    """The words that nearly always have a full stop and do not only end sentences.

    Of ``least`` occurrences or more, ``share`` must have the stop; besides, a word must have four letters at
    most, hold a stop inside, or be followed by a small letter in ``lower`` of the cases.
    """
    total = F.col("with_stop") + F.col("without")
    short = (F.length("word") <= 4) | F.contains("word", F.lit("."))
    known = statistics.filter(
        (F.col("with_stop") >= least)
        & (F.col("with_stop") >= share * total)
        & (short | (F.col("before_lower") >= lower * F.col("with_stop")))
    )
    return [r["word"] for r in known.orderBy(F.desc("with_stop"), "word").limit(MOST).collect()]


def split_sentences(docs: DataFrame, known: Iterable[str], text: str = "content", key: str = "doc_id") -> DataFrame:
    """``(key, pos, sentence)`` like ``explode_sentences``, but neither a known abbreviation nor an
    initial such as ``J.`` ends a sentence. Parts that are put together again are joined by a space.
    """
    listed = sorted(set(known))
    last = lambda part: F.element_at(F.split(part, _GAP), -1)

    def goes_on(part: Column) -> Column:
        held = last(part)
        named = _core(held).isin(listed) if listed else F.lit(False)
        return F.endswith(part, F.lit(".")) & (named | held.rlike(_INITIAL))

    parts = docs.select(key, X.sentences(text).alias("parts"))
    starts = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: (i == 1) | ~goes_on(F.get("parts", i - 2)))
    begun = parts.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("parts") + 1)
    sentences = F.transform("starts", lambda s, k: F.array_join(F.slice("parts", s, end(k) - s), " "))
    return begun.select(key, F.posexplode(sentences).alias("pos", "sentence"))
