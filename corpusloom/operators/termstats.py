"""Term statistics that add up: one table per batch of documents, combined in any order.

A table is ``(term, df, cf)`` with a row for each term, and one without a term whose ``df`` is the
number of documents and whose ``cf`` is the number of tokens. Tables of disjoint batches add up, row by
row, to the table of all their documents, so a corpus that grows is never counted anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K

SCHEMA = "term string, df bigint, cf bigint"


def batch_stats(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The table of a batch, from one pass and one shuffle by term.

    A row of ``docs`` is a document; one with null tokens, or without any, has no terms. Null tokens
    are none.
    """
    known = F.coalesce(F.array_compact(F.col(tokens)), F.array().cast("array<string>"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size(known).cast("bigint").alias("tf")))
    counted = F.concat(whole, F.coalesce(K.count_terms(known), F.array().cast("array<struct<term:string,tf:bigint>>")))
    return docs.select(F.inline(counted)).groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")
    )


def merge_stats(*tables: DataFrame) -> DataFrame:
    """The sum of some tables; associative and commutative."""
    return reduce(DataFrame.unionByName, tables).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def terms_of(table: DataFrame) -> DataFrame:
    """``(term, df, cf)`` without the row of totals."""
    return table.filter("term is not null")


def documents_of(table: DataFrame) -> Column:
    """The number of documents behind a table, 0 for none, as a scalar subquery."""
    return table.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).scalar()


def write_batch(table: DataFrame, path: str, batch: str) -> None:
    """Keep the table of a batch in a folder of its own; a batch that is written again replaces itself."""
    if not batch or "/" in batch or batch.startswith((".", "_")):
        raise ValueError("a batch needs a plain name")
    table.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The sum of all batches below ``path``."""
    return merge_stats(spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path))


def count_stream(stream: DataFrame, path: str, checkpoint: str, tokens: str = "tokens"):
    """A streaming query that keeps the table of every micro-batch of ``stream``.

    A micro-batch that is repeated after a failure has the same number and replaces its table, so
    every document is counted once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        write_batch(batch_stats(batch, tokens), path, f"stream-{number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
