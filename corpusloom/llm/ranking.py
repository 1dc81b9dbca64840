"""Ranked lexical search: accumulators of short lists become one iterator among the long lists."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.terms import coded, parts_of, terms
from corpusloom.session import spread, write_scratch

BLOCK_WORDS = 1 << 22  # words of the documents in one block of the index, a longer document alone
STEP = 2048  # documents that are walked together
UNIT = 1_000_000_000


@dataclass(frozen=True)
class RankParams:
    """``k`` documents an item. Lists of at most ``short`` of a block's documents are summed first.
    Items are searched for in blocks of about ``block_bytes`` of their text. ``length`` in 100 is the
    weight of a document's length."""

    k: int = 10
    short: float = 1 / 32
    block_bytes: int = 4 << 20
    length: int = 75


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and the documents that hold each term asked for."""

    documents: int
    words: int
    held_by: dict[int, int]

    def weight(self, term: int) -> int:
        df = self.held_by.get(term, 0)
        return floor(1000 * log((2 * self.documents + 2) / (2 * df + 1)))


_BLOCK = "documents bigint, words bigint, ids array<bigint>, sizes binary, terms binary, ends binary, docs binary, times binary"


def build_index(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """The postings of the terms ``codes`` in ``docs(doc_id, text)``, one row for each block of documents.

    Within a block documents are numbered by ascending id, rows without id last. ``terms`` has the
    codes of its terms, ``ends`` where each one's postings end in ``docs`` (numbers) and ``times``
    (occurrences). ``documents`` and ``words`` count all documents with a term and all terms, also
    those that are not asked for.
    """

    def run(batches):
        held, words = [], 0
        for part in parts_of(batches, 1):
            own, counts = coded(part.column(1).to_pylist(), codes)
            doc = np.repeat(np.arange(len(counts)), counts)
            known = np.flatnonzero(own >= 0)
            keys, times = np.unique(doc[known] * len(codes) + own[known], return_counts=True)
            ids = part.column(0)
            held.append((ids, counts, keys // max(1, len(codes)), keys % max(1, len(codes)), times))
            words += len(own)
            if words >= BLOCK_WORDS:
                yield _block(held)
                held, words = [], 0
        if held:
            yield _block(held)

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return write_scratch(texts.mapInArrow(run, _BLOCK), "index")


def _block(held) -> pa.RecordBatch:
    """One row of the index from the postings of some parts."""
    counts = np.concatenate([c for _, c, *_ in held])
    ids = pa.concat_arrays([i for i, *_ in held])
    first = np.cumsum([0] + [len(c) for _, c, *_ in held])
    doc = np.concatenate([d + at for (_, _, d, _, _), at in zip(held, first)])
    term = np.concatenate([t for *_, t, _ in held])
    times = np.concatenate([n for *_, n in held])
    # Only documents with postings are kept, in the order in which ties are broken.
    with_terms = np.unique(doc)
    absent = ids.is_null().to_numpy(zero_copy_only=False)[with_terms]
    value = ids.fill_null(0).to_numpy()[with_terms]
    order = np.lexsort((value, absent))
    number = np.zeros(len(counts), np.int64)
    number[with_terms[order]] = np.arange(len(order))
    doc = number[doc]
    by_term = np.lexsort((doc, term))
    codes, starts = np.unique(term[by_term], return_index=True)
    as_bytes = lambda values, kind: pa.array([np.asarray(values).astype(kind).tobytes()], pa.binary())
    kept = ids.take(pa.array(with_terms[order]))
    columns = [
        pa.array([int((counts > 0).sum())]),
        pa.array([int(counts.sum())]),
        pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept),
        as_bytes(counts[with_terms[order]], np.int64),
        as_bytes(codes, np.int32),
        as_bytes(np.append(starts[1:], len(term)), np.int64) if len(codes) else as_bytes([], np.int64),
        as_bytes(doc[by_term], np.int32),
        as_bytes(times[by_term], np.int64),
    ]
    return pa.RecordBatch.from_arrays(columns, ["documents", "words", "ids", "sizes", "terms", "ends", "docs", "times"])


def corpus_counts(index: DataFrame) -> Corpus:
    """The sums over all blocks; one row for each term of the index reaches the driver."""

    def run(batches):
        for batch in batches:
            for held, ends in zip(batch.column(0), batch.column(1)):
                codes = np.frombuffer(held.as_buffer(), np.int32)
                n = np.diff(np.frombuffer(ends.as_buffer(), np.int64), prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["term", "n"])

    held = index.select("terms", "ends").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    sums = index.agg(F.sum("documents").alias("d"), F.sum("words").alias("w")).first()
    return Corpus(sums["d"] or 0, sums["w"] or 0, {r["term"]: r["n"] for r in held.collect()})


class Best:
    """The ``k`` best documents of an item so far: highest score first, then smallest id, none last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        rows = self.rows + [(-s, i is None, i or 0, i) for s, i in zip(scores.tolist(), ids)]
        self.rows = sorted(rows, key=lambda r: r[:3])[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def search_block(lists: list[tuple[np.ndarray, np.ndarray]], n: int, ids: list, best: Best, short: float) -> None:
    """Add a block's documents to ``best``. ``lists`` has documents, ascending, and scores per term.

    Term at a time, lists of at most ``short * n`` documents are summed into accumulators, which
    stand beside the long lists as one more iterator, bounded by the largest sum. Document at a
    time, ``STEP`` numbers a step, only documents are scored that lie in an essential iterator: one of
    those whose bounds, added up from the smallest, reach the kth score so far. The others are
    looked up for the documents that can still reach it, the largest bound first.
    """
    lists = sorted(lists, key=lambda x: len(x[0]))
    few = sum(len(docs) <= short * n for docs, _ in lists)
    iterators = lists[few:]
    if few:
        sums = np.zeros(n, np.int64)
        for docs, scores in lists[:few]:
            sums[docs] += scores
        docs = np.flatnonzero(sums)
        iterators = [(docs, sums[docs]), *iterators]
    iterators = sorted(((int(s.max()), d, s) for d, s in iterators if len(d)), key=lambda x: x[0])
    reach = np.cumsum([b for b, *_ in iterators])
    for low in range(0, n, STEP):
        essential = int(np.searchsorted(reach, best.least))
        if essential == len(iterators):
            return
        sums = np.zeros(STEP, np.int64)
        for _, docs, scores in iterators[essential:]:
            a, b = np.searchsorted(docs, (low, low + STEP))
            sums[docs[a:b] - low] += scores[a:b]
        found = np.flatnonzero(sums)
        for i in range(essential - 1, -1, -1):
            found = found[sums[found] + reach[i] >= best.least]
            if not len(found):
                break
            _, docs, scores = iterators[i]
            at = np.searchsorted(docs, found + low)
            there = at < len(docs)
            there[there] = docs[at[there]] == found[there] + low
            sums[found[there]] += scores[at[there]]
        found = found[sums[found] >= best.least]
        if len(found) > best.k:
            # Documents are numbered by id, so the first ones of a score are those to keep.
            found = np.sort(found[np.argsort(-sums[found], kind="stable")[: best.k]])
        if len(found):
            best.add(sums[found], [ids[low + i] for i in found.tolist()])


def search_index(index: DataFrame, queries: list[tuple[int, Counter]], corpus: Corpus, params: RankParams) -> DataFrame:
    """``(query, doc_id, score)``: for each task the ``k`` best documents of each query in its blocks.

    The kth score of a query is carried from block to block within a task.
    """
    weights = {t: corpus.weight(t) for _, held in queries for t in held}
    documents, words = corpus.documents, corpus.words

    def run(batches):
        best = {q: Best(params.k) for q, _ in queries}
        for batch in batches:
            for row in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch.column(c)[row].as_buffer(), kind)
                ids = batch.column(0)[row].as_py()
                size, codes, ends = read(1, np.int64), read(2, np.int32), read(3, np.int64)
                docs, times = read(4, np.int32), read(5, np.int64)
                length = (100 - params.length) + (params.length * size * documents) // max(1, words)
                part = (UNIT * times) // (1000 * times + 8 * length[docs])
                of = {t: (docs[b:e], weights[t] * part[b:e]) for t, b, e in zip(codes.tolist(), [0, *ends.tolist()], ends.tolist()) if weights[t]}
                for q, held in queries:
                    lists = [(of[t][0], n * of[t][1]) for t, n in held.items() if t in of]
                    search_block(lists, len(ids), ids, best[q], params.short)
        rows = [(q, r[3], -r[0]) for q, held in best.items() for r in held.rows]
        for at in range(0, len(rows), 1 << 16):
            columns = zip(*rows[at : at + (1 << 16)])
            arrays = [pa.array(list(c), pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, ["query", "doc_id", "score"])

    blocks = spread(index.select("ids", "sizes", "terms", "ends", "docs", "times"))
    return blocks.mapInArrow(run, "query bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, params: RankParams = RankParams()) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item, best first.

    Terms are those of ``terms``; a document's score is the sum, over an item's terms with repeats,
    of the term's weight times (10^9 tf) div (1000 tf + 8 m), m = 100 - length + (length n N) div L.
    Documents without a common term of some weight are not ranked. Equal scores are ordered by
    ascending ``doc_id``, rows without id last.

    Items are dealt into blocks by a hash, so that their terms fit any task; for each block the
    documents are read once, into an index that is written to the shared folder and searched. The
    index of a block of documents is searched by one task and gives ``k`` rows an item at most; those
    are ranked in two steps. Null and empty texts have no terms; repeated rows of ``docs`` are
    documents of their own; equal rows of ``items`` count once, different texts of one ``item_id``
    are ranked each. Other columns, whatever their names, are left out. Without documents, or
    without items, the result is empty.
    """
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    asked = write_scratch(asked.withColumn("key", F.xxhash64("item_id", "text")), "items")
    size = asked.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n_blocks = max(1, ceil(size / params.block_bytes))
    found = []
    for block in range(n_blocks):
        rows = asked.filter(F.pmod("key", F.lit(n_blocks)) == block).collect()
        if not rows:
            continue
        codes: dict[bytes, int] = {}
        queries = [(i, Counter(codes.setdefault(w, len(codes)) for w in terms(r["text"].encode()))) for i, r in enumerate(rows)]
        index = build_index(docs, codes)
        best = search_index(index, queries, corpus_counts(index), params)
        names = docs.sparkSession.createDataFrame(
            [(i, r["item_id"], r["key"]) for i, r in enumerate(rows)], "query bigint, item_id bigint, key bigint"
        )
        found.append(best.join(F.broadcast(names), "query").drop("query"))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = write_scratch(reduce(DataFrame.unionByName, found), "best")
    # What many tasks have found for one item is ranked in parts first.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(32))
    for own in (Window.partitionBy("key", "item_id", part), Window.partitionBy("key", "item_id")):
        best = best.withColumn("rank", F.row_number().over(own.orderBy(*order))).filter(F.col("rank") <= params.k)
    return best.select("item_id", "rank", "doc_id", "score")
