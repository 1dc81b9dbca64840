"""Mixing sources to target weights: packed blocks, multinomial counts per shard, permuted indexes."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD_GAP
from corpusloom.session import write_scratch

MAX_SOURCES = 100_000


@dataclass(frozen=True)
class MixParams:
    """``share`` of all words to take, ``cap`` times a source at most, blocks of ``block`` words,
    shards of ``shard`` blocks. Source weights repeat in the order of the sources' code points."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    cap: int = 2
    block: int = 128
    shard: int = 4096
    seed: int = 7


def words(text):
    """The words of a text as an array; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    return F.filter(parts, lambda w: w != "")


def n_words(text):
    """The number of words, without copying them: gaps at either end leave an empty part."""
    text = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(text, WORD_GAP))
    return (parts - text.rlike("^[ \t-\r]|^$").cast("int") - text.rlike("[ \t-\r]\\z").cast("int")).cast("bigint")


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; excess is shared again."""
    targets = [0.0] * len(sizes)
    free, left = list(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / weight > cap * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
            left -= targets[i]
        free = [i for i in free if i not in set(full)]
    return targets


def source_plan(docs: DataFrame, params: MixParams) -> DataFrame:
    """One row per source: its number, words, target, blocks, slots, the words its last slot takes
    and the parts it is ordered by.

    A source takes its target, rounded to a whole word, however few words it has: as many whole
    turns of its blocks as fit, then single blocks, the last of them only as far as words are due.
    ``docs`` is ``(source, size)``. The table of sources is the only thing that reaches the driver;
    a mix of more than ``MAX_SOURCES`` sources is refused.
    """
    sums = docs.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    rows = sums.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["words"]) for r in rows]
    weights = [params.weights[i % len(params.weights)] for i in range(len(rows))]
    targets = water_fill(sizes, weights, params.share * sum(sizes), params.cap)
    plan = []
    for i, (row, size, target) in enumerate(zip(rows, sizes, targets)):
        blocks = ceil(size / params.block)
        turns, rest = divmod(min(round(target), params.cap * size), size) if size else (0, 0)
        slots = turns * blocks + ceil(rest / params.block)
        due = (rest - 1) % params.block + 1 if rest else params.block
        parts = max(1, round(row["n"] ** 0.5))
        plan.append((i, row["source"], size, float(target), blocks, slots, due, parts))
    return docs.sparkSession.createDataFrame(
        plan,
        "sid int, source string, source_size bigint, target double, blocks bigint, slots bigint, due int, parts int",
    )


def _rank(values: np.ndarray, seed: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A keyed permutation of 0..size-1, element by element: a small Feistel network whose results
    outside the range are sent through it again."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    size = size.astype(np.uint64)
    while len(todo):
        x, h, m, s = out[todo], half[todo], mask[todo], seed[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            mixed = (right + s + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            left, right = right, left ^ (mixed & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def draw_slots(plan: DataFrame, params: MixParams) -> DataFrame:
    """``(shard, position, sid, turn, block, most)``: what stands in every slot of the mix.

    Each shard draws how many of its slots go to each source from a multinomial distribution; the
    draws of the shards before it, summed, give the index of a source's first slot in it. Slots
    beyond a source's quota pass to the sources that are short of theirs, so that the totals are
    exact. A source's j-th slot is block ``permutation(j mod blocks)`` of its turn ``j div blocks``;
    the permutation keeps the last block, which may be short, at its place. A slot takes the first
    ``most`` words of its block, fewer than the whole block only in a source's last slot.
    """
    spark = plan.sparkSession
    rows = plan.orderBy("sid").collect()
    quota = np.array([r["slots"] for r in rows], dtype=np.int64)
    blocks = np.array([r["blocks"] for r in rows], dtype=np.int64)
    due = np.array([r["due"] for r in rows], dtype=np.int32)
    total = int(quota.sum())
    schema = "shard bigint, position int, sid int, turn int, block bigint, most int"
    if not total:
        return spark.createDataFrame([], schema)
    n_shards, share, size, seed = ceil(total / params.shard), quota / total, params.shard, params.seed
    whole = params.block

    def counts(shard: int) -> np.ndarray:
        here = min(size, total - shard * size)
        return np.random.default_rng([seed, shard]).multinomial(here, share)

    # A group of shards is summed by one task, so the driver holds one row per group and source.
    group = max(1, ceil(n_shards**0.5))

    def sums(frames):
        for frame in frames:
            for g in frame["id"]:
                drawn = sum(counts(s) for s in range(g * group, min(n_shards, (g + 1) * group)))
                yield pd.DataFrame({"g": g, "sid": np.flatnonzero(drawn), "n": drawn[drawn > 0]})

    n_groups = ceil(n_shards / group)
    drawn = spark.range(n_groups).mapInPandas(sums, "g bigint, sid int, n bigint").collect()
    before = np.zeros((n_groups + 1, len(rows)), dtype=np.int64)
    for r in drawn:
        before[r["g"] + 1, r["sid"]] = r["n"]
    before = before.cumsum(axis=0)
    excess = np.maximum(before[-1] - quota, 0)
    short = np.maximum(quota - before[-1], 0)
    excess_from = np.concatenate([[0], excess.cumsum()])
    short_to = short.cumsum()

    def fill(frames):
        for frame in frames:
            for g in frame["id"]:
                used = before[g].copy()
                for shard in range(g * group, min(n_shards, (g + 1) * group)):
                    n = counts(shard)
                    sid = np.repeat(np.arange(len(n)), n)
                    j = np.arange(len(sid)) - np.repeat(n.cumsum() - n, n) + used[sid]
                    used += n
                    over = np.flatnonzero(j >= quota[sid])
                    if len(over):
                        e = excess_from[sid[over]] + j[over] - quota[sid[over]]
                        to = np.searchsorted(short_to, e, side="right")
                        j[over] = before[-1][to] + e - (short_to[to] - short[to])
                        sid[over] = to
                    turn, k = j // blocks[sid], j % blocks[sid]
                    keys = (sid * 1_000_003 + turn * 7919 + seed).astype(np.uint64)
                    inner = np.flatnonzero(k < blocks[sid] - 1)
                    k[inner] = _rank(k[inner], keys[inner], blocks[sid[inner]] - 1)
                    most = np.where(j == quota[sid] - 1, due[sid], np.int32(whole))
                    order = np.random.default_rng([seed, shard, 1]).permutation(len(sid))
                    yield pd.DataFrame(
                        {"shard": shard, "position": order.astype("int32"), "sid": sid.astype("int32"),
                         "turn": turn.astype("int32"), "block": k, "most": most.astype("int32")}
                    )

    return spark.range(n_groups).mapInPandas(fill, schema)


def place_documents(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``sid`` and ``start``, the words of its source that come before a document.

    Within a source documents are ordered by a hash part, then by id. The parts of a source are
    about the square root of its documents, so that neither the documents of a part nor the parts
    of a source make a long group. ``sized`` has ``doc_id``, ``source``, ``size`` and, to order
    rows of equal id, ``tie``.
    """
    numbers = F.broadcast(plan.select("sid", F.col("source").alias("s"), "parts"))
    keyed = sized.join(numbers, F.col("source").eqNullSafe(F.col("s")), "inner").drop("s")
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "tie"), F.col("parts")).cast("int")
    keyed = keyed.withColumn("part", part)
    sums = keyed.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    across = Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("offset"))
    within = (
        Window.partitionBy("sid", "part").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        keyed.join(offsets, ["sid", "part"])
        .withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
        .drop("part", "parts", "offset")
    )


def pieces(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` once for every block it has words in, with ``block``, the words' range
    ``[first, first + n)`` within the document and ``at``, the place of the first one in the block."""
    end = F.col("start") + F.col("size") - 1
    spans = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    out = placed.filter("size > 0").withColumn("block", F.explode(spans))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(end + 1, (F.col("block") + 1) * block)
    return out.withColumns({"first": low - F.col("start"), "n": high - low, "at": low - F.col("block") * block})


def within_slots(joined: DataFrame) -> DataFrame:
    """``pieces`` joined with slots: only the words of ``n`` that the slot takes, none left out whole."""
    return joined.withColumn("n", F.least(F.col("n"), F.col("most") - F.col("at"))).filter("n > 0")


def mix_counts(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs``.

    ``taken`` counts the words of the document that the mix takes, repeats included: never more
    than ``params.cap`` times its size. A null text has size 0 and gives nothing; a null source is a
    source of its own, the last one. Repeated rows are documents of their own. An empty table
    gives an empty result.
    """
    sized = write_scratch(
        docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie")),
        "sizes",
    )
    plan = source_plan(sized, params)
    placed = write_scratch(place_documents(sized, plan).drop("source", "tie"), "places")
    # The slots come from a short range, from which Spark would take them to be few.
    times = draw_slots(plan, params).groupBy("sid", "block", "most").agg(F.count(F.lit(1)).alias("times"))
    taken = (
        within_slots(
            pieces(placed.select("sid", "start", "size"), params.block).join(times.hint("merge"), ["sid", "block"])
        )
        .groupBy("sid", "start")
        .agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
        .hint("merge")
    )
    some, none = placed.filter("size > 0"), placed.filter("size = 0")
    counted = some.join(taken, ["sid", "start"], "left").unionByName(
        none.withColumn("taken", F.lit(None).cast("bigint"))
    )
    named = F.broadcast(plan.select("sid", "source", "source_size", "target"))
    return counted.join(named, "sid").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )


def mix_blocks(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix itself: ``(shard, position, source, turn, block, words)``, one row per slot.

    ``words`` are ``params.block`` words, fewer only in a source's last block and last slot. Nulls, repeats and
    empty tables are treated as in ``mix_counts``.
    """
    sized = docs.select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"), "text"
    )
    sized = write_scratch(sized, "sizes")
    plan = source_plan(sized, params)
    cut = pieces(place_documents(sized, plan).drop("source", "tie"), params.block)
    part = F.slice(words(F.col("text")), (F.col("first") + 1).cast("int"), F.col("n").cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("start", part.alias("words"))))
    packed = cut.groupBy("sid", "block").agg(
        F.flatten(F.transform(ordered, lambda p: p["words"])).alias("words")
    )
    names = F.broadcast(plan.select("sid", "source"))
    slots = draw_slots(plan, params).join(packed.hint("merge"), ["sid", "block"]).join(names, "sid")
    taken = F.slice(F.col("words"), F.lit(1), F.col("most"))
    return slots.select("shard", "position", "source", "turn", "block", taken.alias("words"))


def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """The mix as documents: for each turn of its source the part of a document that was taken.

    Returns the columns of ``docs`` with ``text`` and, where there is one, ``n_chars`` renewed: a
    document taken whole keeps its text, one taken in part has its taken words in order, joined by
    spaces. One that is not taken has no row, one taken twice has two rows.
    """
    # A row's own columns travel in one, so that none can clash with those worked out here.
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").alias("source"),
        n_words(F.col("text")).alias("size"),
        F.xxhash64("text").alias("tie"),
        F.struct(*docs.columns).alias("row"),
        F.monotonically_increasing_id().alias("key"),
    )
    keyed = write_scratch(keyed, "sizes")
    sized = keyed.select("doc_id", "source", "size", "tie", "key")
    plan = source_plan(sized, params)
    placed = write_scratch(place_documents(sized, plan).select("key", "sid", "start", "size"), "places")
    slots = draw_slots(plan, params).select("sid", "turn", "block", "most").hint("merge")
    runs = F.sort_array(F.collect_list(F.struct("first", "n")))
    taken = (
        within_slots(pieces(placed, params.block).join(slots, ["sid", "block"]))
        .groupBy("key", "turn")
        .agg(runs.alias("runs"), F.sum("n").alias("taken"))
        .hint("merge")
    )
    # Words are cut only where a part was taken; slices follow each other in the text.
    all_words = words(F.col("row.text"))
    cut = F.array_join(
        F.flatten(F.transform("runs", lambda r: F.slice(all_words, (r["first"] + 1).cast("int"), r["n"].cast("int")))), " "
    )
    text = F.when(F.col("taken") == F.col("size"), F.col("row.text")).otherwise(cut)
    out = keyed.filter("size > 0").join(taken, "key").withColumn("text", text)
    own = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*((own[c] if c in own else F.col("row").getField(c)).alias(c) for c in docs.columns))
