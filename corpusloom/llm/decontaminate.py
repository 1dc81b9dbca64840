"""Benchmark passages in documents, by a set join on the rarest shingles of every window."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.terms import coded, parts_of, terms
from corpusloom.session import write_scratch

SEGMENT = 4096  # words of an item in one row
AT_ONCE = 1 << 17  # slices that are verified together


@dataclass(frozen=True)
class LeakParams:
    """Windows of ``window`` words, shingles of ``width`` words; ``least`` is the share of a window's
    shingles that a slice of a document must have at their places (1: equal word by word). Items are
    searched for in blocks of about ``block_bytes`` of their text, each in a pass of its own."""

    window: int = 10
    width: int = 3
    least: float = 1.0
    block_bytes: int = 4 << 20


@dataclass
class WindowIndex:
    """Distinct windows of equal length: their words' codes, the items that hold each, and the
    entries of their prefix shingles, sorted by shingle."""

    words: np.ndarray
    width: int
    need: int
    item_of: np.ndarray
    items_from: np.ndarray
    keys: np.ndarray
    window: np.ndarray
    offset: np.ndarray


def item_segments(items: DataFrame, params: LeakParams) -> DataFrame:
    """``(item, words)``: the words of each item joined by spaces, long items in segments that
    overlap so that every window lies in one. Items without id or word give none."""
    step = SEGMENT - params.window + 1

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms(text)
                last = max(1, len(words) - params.window + 1) if words else 0
                rows += [(item, b" ".join(words[i : i + SEGMENT])) for i in range(0, last, step)]
                if len(rows) > 256:
                    yield _segment_rows(rows)
                    rows = []
            yield _segment_rows(rows)

    named = items.filter("item_id is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return named.mapInArrow(run, "item string, words binary").distinct()


def _segment_rows(rows) -> pa.RecordBatch:
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["item", "words"])


def _windows(rows, params: LeakParams):
    """The codes of all words of a block's segments, and by length the distinct windows, the items
    that hold each and where each window's items begin."""
    codes: dict[bytes, int] = {}
    names = sorted({r["item"] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    by_length: dict[int, list] = {}
    for r in rows:
        own = np.array([codes.setdefault(w, len(codes)) for w in bytes(r["words"]).split(b" ")], np.int32)
        size = min(params.window, len(own))
        cut = np.lib.stride_tricks.sliding_window_view(own, size)
        by_length.setdefault(size, []).append((cut, np.full(len(cut), number[r["item"]])))
    out = []
    for size, parts in sorted(by_length.items()):
        words = np.ascontiguousarray(np.concatenate([w for w, _ in parts]))
        _, first, back = np.unique(words.view(f"V{4 * size}").ravel(), return_index=True, return_inverse=True)
        held = np.unique(np.stack([back.ravel(), np.concatenate([i for _, i in parts])], axis=1), axis=0)
        starts = np.searchsorted(held[:, 0], np.arange(len(first) + 1))
        out.append((words[first], held[:, 1], starts))
    return codes, names, out


def _shingles(words: np.ndarray, width: int, n_codes: int) -> np.ndarray:
    """One number for each run of ``width`` words along the last axis."""
    keys = words[..., : words.shape[-1] - width + 1].astype(np.uint64)
    for k in range(1, width):
        keys = keys * np.uint64(n_codes) + words[..., k : words.shape[-1] - width + 1 + k].astype(np.uint64)
    return keys


def _document_shingles(codes: np.ndarray, counts: np.ndarray, width: int, n_codes: int):
    """Positions and shingles of the documents' runs of ``width`` known words."""
    if len(codes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.repeat(counts.cumsum(), counts)
    n = len(codes) - width + 1
    whole = end[:n] - np.arange(n) >= width
    for k in range(width):
        whole &= codes[k : n + k] >= 0
    at = np.flatnonzero(whole)
    keys = codes[at].astype(np.uint64)
    for k in range(1, width):
        keys = keys * np.uint64(n_codes) + codes[at + k].astype(np.uint64)
    return at, keys


def shingle_counts(texts: DataFrame, codes: dict[bytes, int], wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of the sorted shingles ``wanted[width]`` occurs in all of ``texts(text)``.

    A task sums its own documents, so a frequent shingle is one row of each task.
    """

    def run(batches):
        sums = {width: np.zeros(len(keys), np.int64) for width, keys in wanted.items()}
        for part in parts_of(batches, 0):
            words, counts = coded(part.column(0).to_pylist(), codes)
            for width, keys in wanted.items():
                _, found = _document_shingles(words, counts, width, len(codes))
                place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                sums[width] += np.bincount(place[keys[place] == found], minlength=len(keys))
        for width, n in sums.items():
            at = np.flatnonzero(n)
            columns = [pa.array(np.full(len(at), width, np.int32)), pa.array(at), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, ["width", "at", "n"])

    counted = texts.mapInArrow(run, "width int, at bigint, n bigint").groupBy("width", "at").agg(F.sum("n").alias("n"))
    out = {width: np.zeros(len(keys), np.int64) for width, keys in wanted.items()}
    for r in counted.collect():  # at most one row for each shingle of the block
        out[r["width"]][r["at"]] = r["n"]
    return out


def prefix_index(texts: DataFrame, rows, params: LeakParams):
    """``(codes, item names, indexes)`` for the segments of one block.

    A window with s shingles needs ``need`` = ceil(least * s) of them, so one of any s - need + 1 is
    in every occurrence: the rarest ones of the corpus, its prefix, are the only ones joined.
    Windows whose shingles without any occurrence leave fewer than ``need`` occur nowhere.
    """
    codes, names, by_length = _windows(rows, params)
    if not by_length:
        return codes, names, []
    shaped = [(w, _shingles(w, min(params.width, w.shape[1]), len(codes)), min(params.width, w.shape[1])) for w, *_ in by_length]
    wanted = {
        width: np.unique(np.concatenate([s.ravel() for _, s, own in shaped if own == width]))
        for width in {own for *_, own in shaped}
    }
    occurring = shingle_counts(texts, codes, wanted)
    indexes = []
    for (words, shingles, width), (_, item_of, starts) in zip(shaped, by_length):
        rarity = occurring[width][np.searchsorted(wanted[width], shingles)]
        s = shingles.shape[1]
        need = max(1, ceil(params.least * s))
        alive = np.flatnonzero((rarity > 0).sum(axis=1) >= need)
        prefix = np.argsort(rarity[alive], axis=1, kind="stable")[:, : s - need + 1]
        window = np.repeat(alive, prefix.shape[1])
        offset = prefix.ravel()
        keys = shingles[window, offset]
        order = np.argsort(keys, kind="stable")
        indexes.append(
            WindowIndex(words, width, need, item_of, starts, keys[order], window[order], offset[order])
        )
    return codes, names, indexes


def _expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each element of the ranges ``[begin, end)`` comes from, and the element."""
    n = end - begin
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(n.cumsum() - n, n) + begin[which]


def _occurrences(index: WindowIndex, codes: np.ndarray, counts: np.ndarray, n_codes: int):
    """``(start, window)`` of the slices of the documents that contain a window.

    A prefix shingle at a position fixes the slice; slices that do not lie within one document are
    dropped, the others compared with the window word by word.
    """
    at, keys = _document_shingles(codes, counts, index.width, n_codes)
    which, entry = _expanded(np.searchsorted(index.keys, keys), np.searchsorted(index.keys, keys, side="right"))
    size = index.words.shape[1]
    start, window = at[which] - index.offset[entry], index.window[entry]
    ends = counts.cumsum()
    doc = np.searchsorted(ends, at[which], side="right")
    inside = (start >= ends[doc] - counts[doc]) & (start + size <= ends[doc])
    start, window, found = start[inside], window[inside], []
    for i in range(0, len(start), AT_ONCE):
        s, w = start[i : i + AT_ONCE], window[i : i + AT_ONCE]
        same = codes[s[:, None] + np.arange(size)] == index.words[w]
        whole = np.lib.stride_tricks.sliding_window_view(same, index.width, axis=1).all(axis=2)
        found.append(whole.sum(axis=1) >= index.need)
    found = np.concatenate(found) if found else np.zeros(0, bool)
    return start[found], window[found]


def _search(part: pa.RecordBatch, codes: dict[bytes, int], names: list[str], indexes: list[WindowIndex]):
    """For each text of a part its number of words, hit ranges ``[begin, end)`` and sorted items."""
    words, counts = coded(part.column(1).to_pylist(), codes)
    ends = counts.cumsum()
    edge = np.zeros(len(words) + 1, np.int64)
    pairs = []
    for index in indexes:
        start, window = _occurrences(index, words, counts, len(codes))
        np.add.at(edge, start, 1)
        np.subtract.at(edge, start + index.words.shape[1], 1)
        doc = np.searchsorted(ends, start, side="right")
        held = np.unique(np.stack([doc, window], axis=1), axis=0)
        which, place = _expanded(index.items_from[held[:, 1]], index.items_from[held[:, 1] + 1])
        pairs.append(np.stack([held[which, 0], index.item_of[place]], axis=1))
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    items: list[list[str]] = [[] for _ in range(part.num_rows)]
    for d, i in pairs.tolist():
        items[d].append(names[i])
    hit = (edge.cumsum() > 0).astype(np.int8)[:-1]
    spans: list[list[int]] = [[] for _ in range(part.num_rows)]
    if hit.any():
        # A range ends with its document, even where the next one begins with a hit.
        turn = np.flatnonzero(np.diff(hit, prepend=0, append=0))
        for b, e in zip(turn[::2].tolist(), turn[1::2].tolist()):
            d = int(np.searchsorted(ends, b, side="right"))
            while b < e:
                stop = min(e, int(ends[d]))
                if stop > b:
                    begin = int(ends[d] - counts[d])
                    spans[d] += [b - begin, stop - begin]
                b, d = max(b, stop), d + 1
    return counts, spans, items


_ROW = "doc_id bigint, digest binary, n_words bigint, spans array<bigint>, items array<string>"


def _searched(texts: DataFrame, index, every: bool, digests: bool) -> DataFrame:
    """The result of one block for each row, or only for those it has hits in."""
    codes, names, indexes = index

    def run(batches):
        for part in parts_of(batches, 1):
            counts, spans, items = _search(part, codes, names, indexes)
            rows = np.arange(part.num_rows) if every else np.array([i for i, s in enumerate(spans) if s], np.int64)
            texts = part.column(1)
            digest = [hashlib.sha256(texts[i].as_py() or b"").digest() if digests else None for i in rows.tolist()]
            columns = [
                part.column(0).take(pa.array(rows)),
                pa.array(digest, pa.binary()),
                pa.array(counts[rows]),
                pa.array([spans[i] for i in rows.tolist()], pa.list_(pa.int64())),
                pa.array([sorted(items[i]) for i in rows.tolist()], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n_words", "spans", "items"])

    return texts.mapInArrow(run, _ROW)


def _merged(spans):
    """The union of ranges that are listed as begin, end, begin, end, ..."""
    out: list[int] = []
    for b, e in sorted(zip(spans[::2], spans[1::2])):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def find_leaks(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """``(doc_id, n_words, spans, items)`` for every row of ``docs(doc_id, text)``.

    A window is ``params.window`` consecutive words of an item of ``items(item_id, text)``, or a
    shorter item as a whole. It occurs at a slice of a document of the same length that has at least
    ``params.least`` of the window's shingles at their places. ``spans`` lists the word ranges in any
    occurrence as begin, end, begin, end, ... , ``items`` the ids, as sorted strings, of the items
    with an occurring window.

    The items are dealt into blocks by a hash, so that what every task holds is bounded by
    ``params.block_bytes`` whatever their number; each block takes two passes over all documents,
    one for the rarity of its shingles and one for the join. Rows of equal text have equal results.
    Null texts have no words, items without id or without words take no part, items of equal id
    count as one, and other columns of either table, whatever their names, are left out. Without
    documents the result is empty; without items no word is hit.
    """
    segments = write_scratch(item_segments(items, params), "segments")
    size = segments.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    n_blocks = max(1, ceil(size / params.block_bytes))
    dealt = segments.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = []
    for block in range(n_blocks):
        rows = dealt.filter(F.col("block") == block).collect()
        index = prefix_index(texts.select("text"), rows, params)
        result = _searched(texts, index, block == 0, n_blocks > 1)
        if n_blocks == 1:
            return result.drop("digest")
        found.append(write_scratch(result, "leaks").withColumn("block", F.lit(block)))
    # A text's hits of all blocks meet once, whatever the number of rows that have it.
    hits = reduce(DataFrame.unionByName, found).filter(F.size("spans") > 0)
    hits = hits.dropDuplicates(["digest", "block"]).groupBy("digest").agg(
        F.udf(_merged, "array<bigint>")(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    none = lambda c, of: F.coalesce(c, F.array().cast(of))
    return found[0].select("doc_id", "digest", "n_words").join(hits, "digest", "left").select(
        "doc_id", "n_words", none("spans", "array<bigint>").alias("spans"), none("items", "array<string>").alias("items")
    )


def hit_words(spans) -> F.Column:
    """The number of words in ranges listed as begin, end, begin, end, ..."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)
