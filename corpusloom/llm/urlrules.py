"""URL filters: pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import fits_broadcast, lookup_size, write_scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A pattern over host and path, and the literal tokens every match contains.

    ``weight`` ranks rules that fit the same URL: the largest wins, ties go to the smaller name.
    """

    rule: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    weight: int


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host with its subdomains and the paths that begin with ``path``."""
    literal = host + path
    whole = re.split(r"[^a-z0-9]+", literal.lower())
    # The last token may go on in the URL unless the rule ends it.
    tokens = whole if re.search(r"[^A-Za-z0-9]$", literal) else whole[:-1]
    escaped = re.sub(r"([^A-Za-z0-9/])", r"\\\1", literal)
    return Rule(literal, rf"^(?:[^/]*\.)?{escaped}", tuple(t for t in tokens if t), verdict, len(literal))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for URLs that hold ``word`` as a whole token, weaker than any site rule."""
    pattern = rf"(?i)(?:^|[^A-Za-z0-9]){word}(?:[^A-Za-z0-9]|$)"
    return Rule(f"word:{word}", pattern, (word.lower(),), verdict, 0)


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    return spark.createDataFrame(
        [(r.rule, r.pattern, list(r.tokens), r.verdict, r.weight) for r in rules],
        "rule string, pattern string, tokens array<string>, verdict string, weight int",
    )


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def _tokens(site: Column) -> Column:
    # The empty token stands for rules that have no whole literal token.
    return F.array_union(F.array_distinct(F.split(F.lower(site), "[^a-z0-9]+")), F.array(F.lit("")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` to ``pages(url, ...)``.

    A URL's tokens fetch the rules indexed under one of them, and only the patterns of those run.
    Each rule is indexed under the one of its tokens that the fewest distinct URLs hold (counted
    over all of them, ties to the smaller token). ``rule`` is null and ``verdict`` the default
    where no rule fits. Columns of these names that ``pages`` has are replaced; a null url has an
    empty host and path. Equal host and path are judged once; an empty table gives no rows.
    """
    out = ("host", "path", "rule", "verdict")
    kept = pages.drop(*out).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    # A path is empty or begins with "/", which no host holds, so the two can be written together.
    site = F.concat("host", "path")
    tokens = write_scratch(
        kept.select(site.alias("site")).distinct().select("site", F.explode(_tokens(F.col("site"))).alias("token")),
        "url-tokens",
    )
    held = rules.select("rule", F.explode_outer("tokens").alias("token")).withColumn(
        "token", F.coalesce("token", F.lit(""))
    )
    wanted = _small(held.select("token").distinct())
    counts = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        held.join(_small(counts), "token", "left")
        .groupBy("rule")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    index = write_scratch(rules.drop("tokens").join(rarest, "rule"), "url-rules")
    fits = tokens.join(_small(index), "token").filter("site rlike pattern")
    best = fits.groupBy("site").agg(
        F.min(F.struct((-F.col("weight")).alias("w"), "rule", "verdict")).alias("best")
    )
    judged = write_scratch(best.select("site", "best.rule", "best.verdict"), "url-verdicts")
    return (
        kept.withColumn("__site", site)
        .join(judged.withColumnRenamed("site", "__site"), "__site", "left")
        .drop("__site")
        .withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    )


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its measured size allows it."""
    return F.broadcast(df) if fits_broadcast(*lookup_size(df)) else df
