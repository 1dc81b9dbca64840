"""SimHash near-duplicates found through distances to reference fingerprints."""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Forest
from corpusloom.llm.components import connected_components
from corpusloom.session import write_scratch

SHINGLES_AT_ONCE = 1 << 16
BUCKET = 1024  # fingerprints of a crowded bucket that are compared at once, twice this many
TARGET_BUCKET = 8  # mean size of a bucket for evenly spread fingerprints
PIVOTS = np.random.default_rng(20).integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 without a word.

    A-Z are lower-cased, words are runs without space and 0x09 to 0x0D, shingles are ``width``
    words joined by spaces, with repeats. Bits of their XXH64 that are set in more than half the
    shingles are set.
    """
    # On bytes, lower() and split() know exactly these letters and this white space.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[len(words) - n :].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, n, SHINGLES_AT_ONCE):
        part = slice(i, i + SHINGLES_AT_ONCE)
        hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[part], ends[part])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, tie, fp)``, one row per row of ``docs``: a hash of the text to order rows of equal
    id, and the fingerprint's bits as a long."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column(2)]
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fp], ["doc_id", "tie", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(run, "doc_id bigint, tie bigint, fp bigint")


def bit_groups(n: int, radius: int) -> list[range]:
    """64 bits cut into the fewest groups whose keys keep a bucket small for ``n`` fingerprints.

    Of ``g`` groups, ``g - radius`` are equal in a linked pair. Which ``g`` is taken changes the
    work, not the result: every linked pair shares a key for any ``g`` above ``radius``.
    """
    g = radius + 1
    while g < 2 * radius + 2 and n / 2 ** (64 * (g - radius) / g) > TARGET_BUCKET:
        g += 1
    edges = [64 * i // g for i in range(g + 1)]
    return [range(a, b) for a, b in zip(edges, edges[1:])]


def _keys(fp, groups: list[range], radius: int):
    """An array of one bucket key for each choice of ``len(groups) - radius`` groups.

    The distances d of a fingerprint to the references 0 and one-bit e_i give
    d(x, e_i) - d(x, 0) = 1 - 2 x_i: along a group, equal differences are equal bits. So the bits
    themselves stand for those coordinates of the distance table.
    """
    from itertools import combinations

    keys = []
    for t, chosen in enumerate(combinations(groups, len(groups) - radius)):
        mask = sum(1 << i for group in chosen for i in group)
        keys.append(F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*keys)


def near_links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """``(a, b)``: links that connect the same fingerprints as all pairs within ``radius`` bits.

    ``prints`` is ``(fp)``, distinct. Fingerprints meet where the coordinates of ``_keys`` agree. A
    crowded bucket is dealt into hashed parts, and each two parts meet in a task of their own.
    Inside, rows are ordered by the distance to the first pivot and compared while that differs by
    ``radius`` at most; the other pivots' distances discard pairs next, and survivors are verified
    on the fingerprints. Of the links found in a batch only those that join two sets are returned.
    """
    n = prints.count()
    groups = bit_groups(n, radius)
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"), groups, radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / BUCKET).cast("int")
    met = keyed.join(sizes.withColumn("parts", parts), "key")
    part = F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part"))
    pairs = F.transform(
        others, lambda o: F.xxhash64("key", F.least(o, F.col("part")), F.greatest(o, F.col("part")))
    )
    dealt = met.withColumn("part", part).select(
        "fp", F.explode(F.when(F.col("parts") > 1, pairs).otherwise(F.array("key"))).alias("key")
    )
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(int(PIVOTS[0].astype(np.int64)))))
    ordered = dealt.withColumn("d", first).repartition("key").sortWithinPartitions("key", "d")
    return ordered.mapInPandas(lambda frames: _compare(frames, radius), "a bigint, b bigint")


def _compare(frames, radius: int):
    """Links within runs of equal keys; a run that goes on in the next batch is carried over."""
    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        last = frame["key"].to_numpy() == frame["key"].iloc[-1]
        rest, whole = frame[last], frame[~last]
        if len(whole):
            yield _links(whole, radius)
    if rest is not None:
        yield _links(rest, radius)


def _links(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    fp = frame["fp"].to_numpy().view(np.uint64)
    key, first = frame["key"].to_numpy(), frame["d"].to_numpy().astype(np.int16)
    other = [np.bitwise_count(fp ^ p).astype(np.int16) for p in PIVOTS[1:]]
    forest = Forest(len(fp))
    left, shift = np.arange(len(fp)), 0
    while len(left):
        shift += 1
        left = left[left + shift < len(fp)]
        right = left + shift
        left = left[(key[left] == key[right]) & (first[right] - first[left] <= radius)]
        a, b = left, left + shift
        for d in other:
            near = np.abs(d[a] - d[b]) <= radius
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        forest.link(a[near], b[near])
    kept = np.array(forest.kept, dtype=np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": fp[kept[:, 0]].view(np.int64), "b": fp[kept[:, 1]].view(np.int64)})


def simhash_components(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, tie, fp, root, component_id)`` for every row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the
    smallest id that can be reached, the row's own included, ``root`` a fingerprint of the component. Null and empty texts have fingerprint
    0 and are linked like others. Equal texts and repeated rows meet in one fingerprint, which is
    compared once. A row without id gets the component of its fingerprint, null if no row there has
    an id. An empty table gives an empty result.
    """
    prints = write_scratch(fingerprints(docs, width), "fingerprints")
    classes = write_scratch(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "classes"
    )
    joined = connected_components(near_links(classes.select("fp"), radius))
    linked = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    roots = linked.filter("component is not null").groupBy("component").agg(F.min("first").alias("least"))
    named = (
        linked.filter("rows > 1 or component is not null")
        .join(roots, "component", "left")
        .select("fp", F.col("component").alias("root"), F.coalesce("least", "first").alias("component_id"))
    )
    named = write_scratch(named, "components")
    return prints.join(named, "fp", "left").select(
        "doc_id",
        "tie",
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates, one each.

    A group is a component of ``simhash_components``; its row with the smallest id stays, ties to
    the smaller hash of the text. A row without id stays only where no row of its group has one. Of
    rows equal in id and text one stays.
    """
    found = simhash_components(docs, radius, width)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    best = found.groupBy("root").agg(F.min(order).alias("best"))
    chosen = write_scratch(best.select(F.col("best.doc_id").alias("__id"), F.col("best.tie").alias("__tie")), "chosen")
    tied = docs.withColumn("__text", F.xxhash64("text"))
    same = tied["doc_id"].eqNullSafe(chosen["__id"]) & (tied["__text"] == chosen["__tie"])
    kept = tied.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "__text"])
    return kept.select(*docs.columns)
