"""Vectors of nearly the same direction: cover trees, walked in pairs."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import Forest
from corpusloom.llm.components import connected_components
from corpusloom.session import fits_broadcast, lookup_size, write_scratch

NO_ID = 1 << 62  # classes whose rows have no id are numbered from here


@dataclass(frozen=True)
class CoverParams:
    """Pairs of cosine ``threshold`` or more; parts of about ``part`` vectors meet in one task; the
    upper nodes of a label's tree are at most ``tops`` of its vectors, chosen by a hash."""

    threshold: float = 0.98
    part: int = 1024
    tops: int = 32


class CoverTree:
    """Nested levels of nodes over unit vectors; the radius halves from level to level.

    Every level covers all points: a node's points lie within its radius of its centre, and the
    centres of a level are more than the level's radius apart within their parent. The last level
    holds each point by itself. ``node[l]`` is the node of every point, ``centre[l]`` the centre of
    every node and ``radius[l]`` the largest distance within it.
    """

    def __init__(self, points: np.ndarray, least: float):
        n = len(points)
        # Distances from products are rounded; they are used with a margin.
        near = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))
        node, centre = [np.zeros(n, int)], [np.zeros(1, int)]
        r = 1.0
        while r > least / 4 and len(centre[-1]) < n:
            at, centres = np.full(n, -1), []
            for parent, first in enumerate(centre[-1].tolist()):
                left = np.flatnonzero(node[-1] == parent) if len(centre[-1]) < n else np.array([first])
                pick = first
                while True:
                    covered = near[pick, left] <= r
                    covered |= left == pick
                    at[left[covered]] = len(centres)
                    centres.append(pick)
                    left = left[~covered]
                    if not len(left):
                        break
                    pick = int(left[0])
            node.append(at)
            centre.append(np.array(centres))
            r /= 2
        node.append(np.arange(n))
        centre.append(np.arange(n))
        self.points, self.node, self.centre = points, node, centre
        self.radius = []
        for at, c in zip(node, centre):
            far = np.zeros(len(c))
            np.maximum.at(far, at, near[c[at], np.arange(n)])
            self.radius.append(far)
        self.radius[-1][:] = 0.0

    def children(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the next level ordered by parent, and where each parent's begin."""
        parent = self.node[level][self.centre[level + 1]]
        order = np.argsort(parent, kind="stable")
        return order, np.searchsorted(parent[order], np.arange(len(self.centre[level]) + 1))


def dual_links(a: CoverTree, b: CoverTree, wa, wb, norms, threshold: float, forest: Forest, base: int):
    """Weights of the points of ``b`` that each point of ``a`` is linked to, and the reverse.

    Pairs of nodes are walked from the top. A pair further apart than its radii and the threshold
    distance is dropped, one that is wholly within it is counted as it stands, others are opened.
    Pairs of points near the threshold are decided by the cosine itself. Links go to ``forest``,
    where the points of ``b`` are numbered from ``base``.
    """
    reach, margin = float(np.sqrt(2 - 2 * threshold)), 1e-7
    to_a, to_b = np.zeros(len(a.points)), np.zeros(len(b.points))
    depth = max(len(a.node), len(b.node))
    ia, ib = np.zeros(1, int), np.zeros(1, int)
    for level in range(depth):
        la, lb = min(level, len(a.node) - 1), min(level, len(b.node) - 1)
        if level:
            if la == level:
                ia, ib = _opened(*a.children(la - 1), ia, ib)
            if lb == level:
                ib, ia = _opened(*b.children(lb - 1), ib, ia)
        ca, cb = a.centre[la][ia], b.centre[lb][ib]
        d = _distances(a.points, b.points, ca, cb)
        ra, rb = a.radius[la][ia], b.radius[lb][ib]
        maybe = d <= reach + ra + rb + margin
        whole = d + ra + rb <= reach - margin
        _count_whole(a, b, la, lb, ia[whole], ib[whole], wa, wb, to_a, to_b, forest, base)
        ia, ib = ia[maybe & ~whole], ib[maybe & ~whole]
        if not len(ia):
            return to_a, to_b
    xa, xb = a.points[ia], b.points[ib]
    # The last level holds points; the cosine is taken from the vectors as they were given.
    cosine = np.einsum("ij,ij->i", xa * norms[0][ia, None], xb * norms[1][ib, None]) / (norms[0][ia] * norms[1][ib])
    linked = cosine >= threshold
    ia, ib = ia[linked], ib[linked]
    np.add.at(to_a, ia, wb[ib])
    np.add.at(to_b, ib, wa[ia])
    forest.link(ia, ib + base)
    return to_a, to_b


def _opened(order, begin, i, other):
    """Each pair with every child of its node ``i``."""
    counts = begin[i + 1] - begin[i]
    shift = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[np.repeat(begin[i], counts) + shift], np.repeat(other, counts)


def _distances(a, b, ca, cb, at_once: int = 1 << 18):
    """Distances of pairs of points, a bounded number at once; all of them from one product where
    the pairs are most of what there is."""
    if len(ca) * 4 > len(a) * len(b):
        return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))[ca, cb]
    parts = [np.einsum("ij,ij->i", a[ca[s : s + at_once]], b[cb[s : s + at_once]]) for s in range(0, len(ca), at_once)]
    return np.sqrt(np.maximum(2 - 2 * np.concatenate(parts), 0)) if parts else np.zeros(0)


def _count_whole(a, b, la, lb, ia, ib, wa, wb, to_a, to_b, forest, base):
    """Counts pairs of nodes all of whose points are linked, node by node."""
    if not len(ia):
        return
    sum_a = np.bincount(a.node[la], wa, minlength=len(a.centre[la]))
    sum_b = np.bincount(b.node[lb], wb, minlength=len(b.centre[lb]))
    to_a += np.bincount(ia, sum_b[ib], minlength=len(sum_a))[a.node[la]]
    to_b += np.bincount(ib, sum_a[ia], minlength=len(sum_b))[b.node[lb]]
    forest.link(a.centre[la][ia], b.centre[lb][ib] + base)
    # Every point of a node is linked to the other node's centre.
    some_b, some_a = np.full(len(sum_a), -1), np.full(len(sum_b), -1)
    some_b[ia], some_a[ib] = b.centre[lb][ib], a.centre[la][ia]
    pa, pb = np.flatnonzero(some_b[a.node[la]] >= 0), np.flatnonzero(some_a[b.node[lb]] >= 0)
    forest.link(pa, some_b[a.node[la][pa]] + base)
    forest.link(some_a[b.node[lb][pb]], pb + base)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _join_parts(frame: pd.DataFrame, params: CoverParams) -> pd.DataFrame:
    """Links between two parts, or within one: rows ``(a, tie, a, n)`` with the number of rows a
    class is linked to, and rows ``(a, 0, b, 0)`` of links."""
    alone = bool(frame["alone"].iloc[0])
    sides = [g for _, g in frame.groupby("side", sort=True)]
    if len(sides) < 2 and not alone:
        sides = []
    reach = float(np.sqrt(2 - 2 * params.threshold))
    made = {"a": [], "tie": [], "b": [], "n": []}
    if sides:
        vectors = [_vectors(side["v"]) for side in sides]
        norms = [np.linalg.norm(x, axis=1) for x in vectors]
        trees = [CoverTree(x / norm[:, None], reach) for x, norm in zip(vectors, norms)]
        weights = [side["w"].to_numpy(float) for side in sides]
        nodes = np.concatenate([side["node"].to_numpy(np.int64) for side in sides])
        ties = np.concatenate([side["tie"].to_numpy(np.int64) for side in sides])
        forest, last = Forest(len(nodes)), len(sides) - 1
        to_a, to_b = dual_links(
            trees[0], trees[last], weights[0], weights[last], (norms[0], norms[last]),
            params.threshold, forest, len(weights[0]) if last else 0,
        )
        counts = np.concatenate([to_a, to_b]) if last else to_a
        some = np.flatnonzero(counts)
        kept = np.array(forest.kept, dtype=np.int64).reshape(-1, 2)
        made = {
            "a": np.concatenate([nodes[some], nodes[kept[:, 0]]]),
            "tie": np.concatenate([ties[some], 0 * kept[:, 0]]),
            "b": np.concatenate([nodes[some], nodes[kept[:, 1]]]),
            "n": np.concatenate([counts[some].astype(np.int64), 0 * kept[:, 0]]),
        }
    return pd.DataFrame(made)


def _usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, odd) & F.exists(vector, lambda x: x != 0)


_GROUP = ["label", "dims"]


def _upper_nodes(classes: DataFrame, params: CoverParams) -> DataFrame:
    """``(label, dims, tops)``: the vectors of each label's upper nodes.

    A label of at most ``part`` classes has one. Of a larger one as many classes as it has parts,
    ``tops`` at most, are taken, those of smallest hash.
    """
    sizes = classes.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("size"))
    wanted = F.least(F.lit(params.tops), F.ceil(F.col("size") / params.part)).cast("int")
    by_hash = Window.partitionBy(*_GROUP).orderBy(F.xxhash64("tie", "node"), "tie", "node")
    first = classes.withColumn("nth", F.row_number().over(by_hash)).filter(F.col("nth") <= params.tops)
    chosen = first.join(sizes.withColumn("wanted", wanted), _GROUP).filter("nth <= wanted")
    ordered = F.sort_array(F.collect_list(F.struct("nth", "v")))
    return write_scratch(chosen.groupBy(*_GROUP).agg(F.transform(ordered, lambda t: t["v"]).alias("tops")), "tops")


def _placed(classes: DataFrame, tops: DataFrame) -> DataFrame:
    """Add ``top``, the nearest upper node of the label, and ``far``, the distance to it."""

    def nearest(frames):
        for frame in frames:
            top, far = np.zeros(len(frame), np.int32), np.zeros(len(frame))
            for _, g in frame.assign(row=np.arange(len(frame))).groupby(_GROUP):
                x, t = _vectors(g["v"]), np.stack([np.asarray(v, float) for v in g["tops"].iloc[0]])
                x, t = (m / np.linalg.norm(m, axis=1)[:, None] for m in (x, t))
                d = np.sqrt(np.maximum(2 - 2 * x @ t.T, 0))
                top[g["row"]], far[g["row"]] = d.argmin(1), d.min(1)
            yield frame[["label", "dims", "node", "tie", "w", "v"]].assign(top=top, far=far)

    sent = F.broadcast(tops) if fits_broadcast(*lookup_size(tops)) else tops
    rows = classes.join(sent, _GROUP).select("label", "dims", "node", "tie", "w", "v", "tops")
    schema = "label int, dims int, node bigint, tie bigint, w bigint, v array<double>, top int, far double"
    return write_scratch(rows.mapInPandas(nearest, schema), "placed")


def _meetings(placed: DataFrame, tops: DataFrame, params: CoverParams) -> DataFrame:
    """``placed`` once for every pair of parts it belongs to.

    Pairs of upper nodes whose distance exceeds their covering radii and the threshold distance
    have no link and are left out. A crowded node is dealt into parts by a hash, and each two parts
    meet in a group of their own; a part meets itself where ``alone`` holds.
    """
    reach = float(np.sqrt(2 - 2 * params.threshold))
    nodes = placed.groupBy(*_GROUP, "top").agg(
        F.max("far").alias("radius"), F.ceil(F.count(F.lit(1)) / params.part).cast("int").alias("parts")
    )
    other = nodes.select(*_GROUP, *(F.col(c).alias(f"{c}2") for c in ("top", "radius", "parts")))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    one, two = F.get("tops", F.col("top")), F.get("tops", F.col("top2"))
    dot = F.aggregate(F.zip_with(one, two, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot / (norm(one) * norm(two))))
    pairs = nodes.join(other, _GROUP).filter("top <= top2").join(tops, _GROUP)
    pairs = pairs.filter(apart <= F.col("radius") + F.col("radius2") + reach + 1e-6)
    pairs = write_scratch(pairs.select(*_GROUP, "top", "top2", "parts", "parts2"), "pairs")
    hashed, size = F.xxhash64("node", "tie", F.lit("part")), F.col("top") == F.col("top2")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*_GROUP, "top", "top2", "p", "p2", "side", "alone", "node", "tie", "w", "v"]
    left = (
        placed.join(pairs, [*_GROUP, "top"])
        .withColumns({"p": F.pmod(hashed, F.col("parts")).cast("int"), "side": F.lit(0)})
        .withColumn("p2", all_of("parts2"))
        .withColumn("alone", size & (F.col("p") == F.col("p2")))
        .filter("top < top2 or p <= p2")
    )
    right = (
        placed.withColumnRenamed("top", "top2")
        .join(pairs, [*_GROUP, "top2"])
        .withColumns({"p2": F.pmod(hashed, F.col("parts2")).cast("int"), "side": F.lit(1), "alone": F.lit(False)})
        .withColumn("p", all_of("parts"))
        .filter("top < top2 or p < p2")
    )
    return left.select(*columns).unionByName(right.select(*columns))


def similar_vectors(vectors: DataFrame, params: CoverParams = CoverParams()) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors are linked if their labels are equal and not null and their cosine, in double
    precision, is at least ``params.threshold``. ``n_links`` counts the other rows a row is linked
    to, ``component_id`` is the smallest id that can be reached, the row's own included, and
    ``kept`` is whether that is the row's own. Vectors that are null, zero, hold null or non-finite
    components or have no label are linked to nothing, as are vectors of different lengths. Equal
    vectors are compared once and counted as often as they occur. Rows of one id are one vertex
    where components are concerned. A row without id can be linked; its component is null if no
    row in it has an id, and it is never kept. An empty table gives an empty result.
    """
    valid = _usable(F.col("embedding")) & F.col("label").isNotNull()
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.when(valid, F.col("label").cast("int")).alias("label"),
        F.when(valid, F.transform("embedding", lambda x: x.cast("double"))).alias("v"),
    )
    rows = write_scratch(rows.withColumn("tie", F.xxhash64("v")), "vectors")
    unnamed = F.lit(NO_ID) + F.xxhash64("label", "v").bitwiseAND(F.lit((1 << 61) - 1))
    classes = (
        rows.filter("v is not null")
        .groupBy("label", "tie", "v")
        .agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("w"))
        .select("label", "tie", "v", "w", F.size("v").alias("dims"), F.coalesce("first", unnamed).alias("node"))
    )
    classes = write_scratch(classes, "classes")
    tops = _upper_nodes(classes, params)
    placed = _placed(classes, tops)
    met = _meetings(placed, tops, params).groupBy(*_GROUP, "top", "top2", "p", "p2")
    joined = met.applyInPandas(lambda f: _join_parts(f, params), "a bigint, tie bigint, b bigint, n bigint")
    joined = write_scratch(joined, "joined")
    counts = joined.filter("n > 0").groupBy(F.col("a").alias("node"), "tie").agg(F.sum("n").alias("n"))
    components = connected_components(joined.filter("n = 0").select("a", "b"))
    named = classes.join(counts, ["node", "tie"], "left").join(components, "node", "left").select(
        "label", "tie", "v", F.coalesce("n", "w").alias("n"), F.coalesce("component", "node").alias("component")
    )
    named = write_scratch(named, "components")
    found = rows.join(named, ["label", "tie", "v"], "left")
    component = F.when(F.col("component").isNull(), F.col("vec_id")).when(F.col("component") < NO_ID, F.col("component"))
    return found.select(
        "vec_id",
        (F.coalesce("n", F.lit(1)) - 1).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
