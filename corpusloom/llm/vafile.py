"""Exact top-k search over a vector-approximation file."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import write_scratch

LIMIT = 1 << 62  # larger components are cut to this


@dataclass(frozen=True)
class VaParams:
    """``k`` results; vectors are scanned in blocks of ``block`` against blocks of ``queries``;
    every query block meets the vector blocks in ``lanes`` tasks."""

    k: int = 5
    block: int = 4096
    queries: int = 512
    lanes: int = 16


def _usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd)


def whole_components(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * x)`` of every component, as longs."""
    bound = float(LIMIT)
    cut = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(bound)), F.lit(-bound)))
    return F.transform(vector, lambda x: cut(x).cast("bigint"))


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    lengths = column.map(len).to_numpy()
    if len(lengths) and (lengths == dims).all():
        return np.stack(column.to_list()).astype(np.int64)
    out = np.zeros((len(column), dims), dtype=np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


@dataclass(frozen=True)
class Cells:
    """A grid for each component: ``marks`` are 257 cell borders, the outer ones the true extremes."""

    marks: np.ndarray

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty(vectors.shape, dtype=np.uint8)
        for i, marks in enumerate(self.marks):
            out[:, i] = np.clip(np.searchsorted(marks[1:-1], vectors[:, i], side="right"), 0, 255)
        return out

    def middles(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The middle of every cell and half its width."""
        low, high = self.marks[:, :-1], self.marks[:, 1:]
        at = np.arange(len(self.marks))
        return ((low + high) / 2)[at, codes], ((high - low) / 2)[at, codes]


def fit_cells(vectors: DataFrame) -> Cells:
    """Cells from the mean, spread and extremes of each component over all of ``vectors(c)``.

    254 cells of equal width cover four standard deviations around the mean, two outer cells the
    rest; the grid decides how much is read, never what is found.
    """

    def moments(frames):
        for frame in frames:
            if not len(frame):
                continue
            dims = int(frame["c"].map(len).max())
            m = _matrix(frame["c"], dims).astype(float)
            yield pd.DataFrame(
                {"i": np.arange(dims), "n": len(m), "s": m.sum(0), "q": (m * m).sum(0), "lo": m.min(0), "hi": m.max(0)}
            )

    sums = (
        vectors.select("c")
        .mapInPandas(moments, "i int, n bigint, s double, q double, lo double, hi double")
        .groupBy("i")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .orderBy("i")
        .toPandas()
    )
    n, mean = sums["n"].to_numpy(), (sums["s"] / sums["n"]).to_numpy()
    spread = np.sqrt(np.maximum((sums["q"] / n).to_numpy() - mean**2, 0)) * 4 + 0.5
    # Vectors that end before a component have a zero there.
    low, high = np.minimum(sums["lo"], 0).to_numpy(), np.maximum(sums["hi"], 0).to_numpy()
    inner = mean[:, None] + spread[:, None] * np.linspace(-1, 1, 255)
    marks = np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None]), high[:, None]], axis=1)
    return Cells(marks)


def _bounds(cells: Cells, queries: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and approximated vectors."""
    middle, half = cells.middles(codes)
    q = queries.astype(float)
    centre, reach = q @ middle.T, np.abs(q) @ half.T
    # The sums are rounded; this is far more than they can be off.
    slack = 1e-12 * (np.abs(q).sum(1) * float(np.abs(middle).max(initial=0) + half.max(initial=0)))[:, None] + 1e-6
    return centre - reach - slack, centre + reach + slack


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products of integers; those outside the range of a long are cut to it."""
    rough = (np.abs(a).astype(float) * np.abs(b).astype(float)).sum(1)
    out = (a * b).sum(1)
    for i in np.flatnonzero(rough >= 2.0**62):
        true = sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[i].tolist()))
        out[i] = min(max(true, -(2**63)), 2**63 - 1)
    return out


def top_k(vectors: DataFrame, is_query: Column, params: VaParams = VaParams()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the best inner products of whole components.

    ``vectors`` is ``(vec_id, embedding)``. Rows where ``is_query`` holds ask, all others answer,
    but for those with the query's own id; ties go to the smaller id. Fewer than ``k`` answers are
    all returned. Vectors that are null or hold null or non-finite components, and rows without
    id, take no part. Rows of equal id and vector are one; of rows of one id with different vectors
    each asks and answers. Vectors of different lengths meet as if filled up with zeros. An empty
    table gives an empty result.

    Of equal vectors only the ``k + 1`` smallest ids can be among anyone's results, so the others
    are not looked at. The approximations give bounds for every pair of query and vector, block
    against block; a query's candidates are those whose upper bound reaches its kth lower bound.
    Exact vectors are then read by falling upper bound: first the ``k`` foremost, whose kth score
    decides which of the others can still be better, then just those.
    """
    k = params.k
    rows = (
        vectors.filter(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
        .withColumn("asks", F.coalesce(is_query, F.lit(False)))
        .select("vec_id", whole_components(F.col("embedding")).alias("c"), "asks")
        .withColumn("tie", F.xxhash64("c"))
    )
    rows = write_scratch(rows.dropDuplicates(["vec_id", "tie", "c"]), "vectors")
    equal = Window.partitionBy("tie", "c").orderBy("vec_id")
    answers = rows.withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1).select("vec_id", "tie", "c")
    answers = write_scratch(answers, "answers")
    asked = rows.filter("asks").select("vec_id", "tie", "c")
    sizes = answers.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("c")), F.lit(0))).first()
    if not sizes[0] or not sizes[1]:
        return _ranked(_all_zero(answers, asked, k), k)
    dims = int(sizes[1])
    cells = fit_cells(answers)
    size = params.block

    def pack(frames):
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                codes = cells.codes(_matrix(part["c"], dims))
                yield pd.DataFrame(
                    {"vec": [part["vec_id"].to_numpy(np.int64).tobytes()], "vtie": [part["tie"].to_numpy(np.int64).tobytes()], "codes": [codes.tobytes()]}
                )

    def pack_queries(frames):
        for frame in frames:
            for at in range(0, len(frame), params.queries):
                part = frame.iloc[at : at + params.queries]
                yield pd.DataFrame(
                    {"q": [part["vec_id"].to_numpy(np.int64).tobytes()], "qtie": [part["tie"].to_numpy(np.int64).tobytes()],
                     "qc": [_matrix(part["c"], dims).tobytes()]}
                )

    scan = write_scratch(answers.mapInPandas(pack, "vec binary, vtie binary, codes binary"), "approximations")
    # Queries are brought together, so that blocks are full wherever they come from.
    parts = max(1, asked.count() // params.queries)
    together = asked.repartition(parts, "vec_id", "tie")
    asking = write_scratch(together.mapInPandas(pack_queries, "q binary, qtie binary, qc binary"), "queries")
    return _ranked(_search(answers, asked, scan, asking, cells, dims, params), k)


def _all_zero(answers: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Scores where no vector has a component, or none is there: zero for each pair."""
    first = answers.select("vec_id").distinct().orderBy("vec_id").limit(k + 1)
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("tie").alias("qtie")).join(
        F.broadcast(first), F.col("vec_id") != F.col("query_id")
    )
    return pairs.withColumn("score", F.lit(0).cast("bigint"))


def _search(answers, asked, scan, blocks_of_queries, cells, dims, params) -> DataFrame:
    k, lanes = params.k, params.lanes
    lane = F.pmod(F.xxhash64("vec"), F.lit(lanes)).cast("int")
    blocks = scan.withColumn("lane", lane)
    asking = blocks_of_queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def bound(frames):
        best: dict[bytes, np.ndarray] = {}
        for frame in frames:
            for row in frame.itertuples():
                vec, tie = np.frombuffer(row.vec, np.int64), np.frombuffer(row.vtie, np.int64)
                q, qtie = np.frombuffer(row.q, np.int64), np.frombuffer(row.qtie, np.int64)
                queries = np.frombuffer(row.qc, np.int64).reshape(-1, dims)
                low, high = _bounds(cells, queries, np.frombuffer(row.codes, np.uint8).reshape(-1, dims))
                own = q[:, None] == vec[None, :]
                low[own] = -np.inf
                # The kth lower bound seen so far; what cannot reach it is no candidate.
                seen = best.get(row.q + row.qtie)
                pool = low if seen is None else np.concatenate([seen, low], axis=1)
                keep = min(k, pool.shape[1])
                top = -np.partition(-pool, keep - 1, axis=1)[:, :keep]
                best[row.q + row.qtie] = top
                floor = top.min(1) if keep == k else np.full(len(q), -np.inf)
                i, j = np.nonzero((high >= floor[:, None]) & ~own)
                yield pd.DataFrame(
                    {"query_id": q[i], "qtie": qtie[i], "vec_id": vec[j], "tie": tie[j], "low": low[i, j], "high": high[i, j]}
                )

    pairs = blocks.join(asking, "lane").mapInPandas(
        bound, "query_id bigint, qtie bigint, vec_id bigint, tie bigint, low double, high double"
    )
    found = write_scratch(pairs, "bounds")
    key = ["query_id", "qtie"]
    lowest = Window.partitionBy(*key).orderBy(F.desc("low"), "vec_id", "tie")
    floors = (
        found.select(*key, "low", "vec_id", "tie")
        .withColumn("nth", F.row_number().over(lowest))
        .filter(F.col("nth") <= k)
        .groupBy(*key)
        .agg(F.min("low").alias("floor"), F.count(F.lit(1)).alias("n"))
        .select(*key, F.when(F.col("n") >= k, F.col("floor")).otherwise(float("-inf")).alias("floor"))
    )
    highest = Window.partitionBy(*key).orderBy(F.desc("high"), "vec_id", "tie")
    order = (
        found.join(floors, key)
        .filter("high >= floor")
        .select(*key, "vec_id", "tie", "high")
        .withColumn("nth", F.row_number().over(highest))
    )
    order = write_scratch(order, "candidates")
    first = write_scratch(_read_exact(order.filter(F.col("nth") <= k), answers, asked, dims), "first")
    certain = (
        first.groupBy(*key)
        .agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
        .select(*key, F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(float("-inf")).alias("kth"))
    )
    rest = order.filter(F.col("nth") > k).join(certain, key).filter("high >= kth")
    return first.unionByName(_read_exact(rest, answers, asked, dims))


def _read_exact(wanted: DataFrame, answers: DataFrame, asked: DataFrame, dims: int) -> DataFrame:
    def score(frames):
        for frame in frames:
            made = exact_scores(_matrix(frame["c"], dims), _matrix(frame["qc"], dims)) if len(frame) else []
            yield frame[["query_id", "qtie", "vec_id"]].assign(score=made)

    asking = asked.select(F.col("vec_id").alias("query_id"), F.col("tie").alias("qtie"), F.col("c").alias("qc"))
    read = wanted.select("query_id", "qtie", "vec_id", "tie").join(answers, ["vec_id", "tie"]).join(asking, ["query_id", "qtie"])
    return read.select("query_id", "qtie", "vec_id", "c", "qc").mapInPandas(
        score, "query_id bigint, qtie bigint, vec_id bigint, score bigint"
    )


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "qtie").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
