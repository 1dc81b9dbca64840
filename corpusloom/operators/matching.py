"""Agreement of two sets of topics: a one-to-one matching by common terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left, right, common)``: the terms that topics of two tables ``(topic, term)`` share, if any."""
    a = left.select(F.col("topic").alias("left"), "term").distinct()
    b = right.select(F.col("topic").alias("right"), "term").distinct()
    return a.join(b, "term").groupBy("left", "right").agg(F.count(F.lit(1)).alias("common"))


def match_topics(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left, right, common)``: each topic of ``left`` with one of its own in ``right``, so that the
    sum of common terms is largest; of equal sums the one found first by ascending topics.

    A topic for which none is left has a null. Both tables are ``(topic, term)``; the driver
    holds one number for each pair of topics.
    """
    spark = left.sparkSession
    rows = [r["topic"] for r in left.select("topic").distinct().orderBy("topic").collect()]
    columns = [r["topic"] for r in right.select("topic").distinct().orderBy("topic").collect()]
    common = {(r["left"], r["right"]): r["common"] for r in term_overlap(left, right).collect()}
    size = max(len(rows), len(columns))
    gain = [[common.get((a, b), 0) for b in columns] + [0] * (size - len(columns)) for a in rows]
    gain += [[0] * size for _ in range(size - len(rows))]
    chosen = _assignment(gain)
    out = []
    for i, a in enumerate(rows):
        b = columns[chosen[i]] if chosen[i] < len(columns) else None
        out.append((a, b, gain[i][chosen[i]]))
    kind = left.schema["topic"].dataType.simpleString()
    return spark.createDataFrame(out, f"left {kind}, right {right.schema['topic'].dataType.simpleString()}, common bigint")


def _assignment(gain: list[list[int]]) -> list[int]:
    """The column of every row in the best assignment: rows are added one by one along the cheapest
    path of changes, with prices that keep all reduced costs at 0 or above."""
    n = len(gain)
    row_price, column_price, owner = [0] * n, [0] * (n + 1), [-1] * (n + 1)
    for row in range(n):
        owner[n], here = row, n
        least, came, done = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[here] != -1:
            done[here] = True
            i, step, nearest = owner[here], float("inf"), -1
            for j in range(n):
                if not done[j]:
                    cost = -gain[i][j] - row_price[i] - column_price[j]
                    if cost < least[j]:
                        least[j], came[j] = cost, here
                    if least[j] < step:
                        step, nearest = least[j], j
            for j in range(n + 1):
                if done[j]:
                    row_price[owner[j]] += step
                    column_price[j] -= step
                elif j < n:
                    least[j] -= step
            here = nearest
        while here != n:
            owner[here], here = owner[came[here]], came[here]
    chosen = [0] * n
    for j in range(n):
        chosen[owner[j]] = j
    return chosen
