"""Phrase collocations from stripes: each prefix keys a counter of the words that follow it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.terms import parts_of
from corpusloom.session import write_scratch

PART = 1 << 24  # bytes of text that a task turns into stripes at once
SLICE = 1 << 20  # occurrences of a prefix for which its stripe is cut in one more slice
BUCKETS = 1 << 16  # of prefixes, by hash: how many slices their stripes are cut in
REST = b""  # the entry for phrase ends and for words that cannot make a candidate


@dataclass(frozen=True)
class PhraseParams:
    """Phrases of 2 to ``longest`` words with ``least`` occurrences or more; ``top`` phrases a
    language. A phrase goes if a longer one has ``within`` % of its occurrences or more. ``bits`` is
    the size of the filter that knows the frequent phrases one word shorter: beyond about that
    many of them more is counted than needed, with the same result."""

    longest: int = 3
    least: int = 10
    within: int = 50
    top: int = 2000
    bits: int = 1 << 26


def _as_phrase_byte(c: int) -> int:
    if 0x41 <= c <= 0x5A:
        return c + 32
    if c in b".,;:!?" or 0x0A <= c <= 0x0D:
        return 0x0A
    return 0x20 if c == 0x09 else c


_BYTES = bytes(map(_as_phrase_byte, range(256)))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, and a line feed for every end of a piece."""
    return [t for t in text.translate(_BYTES).replace(b"\n", b" \n ").split(b" ") if t]


def _slices(text: bytes, ahead: int, size: int) -> Iterator[tuple[list[bytes], int]]:
    """The tokens of a text in slices, with the first ``ahead`` tokens of what follows, and how
    many of them are the slice's own."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and _BYTES[text[cut]] not in b" \n":
            cut += 1
        own, reach = tokens(text[start:cut]), 1 << 12
        while len(next_ := tokens(text[cut : cut + reach])) <= ahead and cut + reach < len(text):
            reach *= 2
        yield own + next_[:ahead], len(own)
        start = cut
    own = tokens(text[start:])
    yield own, len(own)


def _finished(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(31))) * _MIX
    return mixed ^ (mixed >> np.uint64(29))


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_hash(words: list[bytes], lang: str) -> int:
    """A 64-bit hash of a phrase of a language, made up word by word."""
    held = np.zeros(1, np.uint64)
    for h in _word_hashes(words, lang):
        held = held * _GOLD + h
    return int(_finished(held)[0])


class _Filter:
    """Which phrase hashes may be frequent: a bitmap, addressed by the upper bits."""

    def __init__(self, held: np.ndarray):
        self.held, self.shift = held, np.uint64(64 - int(len(held) * 64 - 1).bit_length())

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def _split(text: bytes) -> pa.Array:
    """Like ``tokens``, as an Arrow array, with empty words between separators."""
    spaced = pa.array([text.translate(_BYTES).replace(b"\n", b" \n ")], pa.large_binary())
    return pc.split_pattern(spaced, pattern=b" ").flatten()


def _stripes(found: pa.Array, own: int | None, lang: str, size: int, frequent: _Filter | None):
    """The stripes of prefixes of ``size`` words in some tokens: their prefixes, those' hashes, where
    each one's entries end, next words (numbers of names, -1 for ``REST``) and counts of all entries
    in a row, and the names and their hashes. Only prefixes among the first ``own`` tokens count.

    Prefixes that cannot be frequent have no stripe; next words that cannot make a frequent phrase,
    and ends of pieces, are counted under ``REST``, so that every stripe adds up to its prefix.
    """
    encoded = found.dictionary_encode()
    names, codes = encoded.dictionary.to_pylist(), encoded.indices.to_numpy().copy()
    number = {w: i for i, w in enumerate(names) if w in (b"", b"\n")}
    codes = codes[codes != number.get(b"", -1)]
    codes[codes == number.get(b"\n", -1)] = -1
    own = len(codes) if own is None else own
    # A phrase goes to the end of the tokens at most; behind them stands an end of a piece.
    codes = np.concatenate([codes, np.full(size + 1, -1, codes.dtype)])
    hashed = _word_hashes(names, lang)
    starts = np.flatnonzero(codes[:own] >= 0)
    for k in range(1, size):
        starts = starts[codes[starts + k] >= 0]
    held = np.zeros(len(starts), np.uint64)
    parts = [codes[starts + k] for k in range(size)]
    for c in parts:
        held = held * _GOLD + hashed[c]
    if frequent is not None:
        likely = frequent.may_hold(_finished(held))
        starts, held = starts[likely], None
        parts = [c[likely] for c in parts]
    follows = codes[starts + size]
    if frequent is not None:
        # The phrase without its first word must be frequent as well.
        inner = np.zeros(len(starts), np.uint64)
        for c in (*parts[1:], np.maximum(follows, 0)):
            inner = inner * _GOLD + hashed[c]
        follows = np.where(frequent.may_hold(_finished(inner)), follows, -1)
        del inner
    base = len(names) + 1
    keys = np.zeros(len(starts), np.int64)
    for k, c in enumerate(parts):
        # Numbers of long prefixes are made small again before they can run over.
        if k and float(len(names)) ** (k + 1) * base > 2**62:
            _, keys = np.unique(keys, return_inverse=True)
            keys = keys.ravel()
        keys = keys * len(names) + c
    keys, first, counts = _counted(keys * base + follows + 1)
    of, word = keys // base, keys % base - 1
    begins = np.flatnonzero(np.diff(of, prepend=-1)) if len(of) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(of)) if len(of) else begins
    spelled = [names[i] for i in parts[0][first[begins]].tolist()] if size else [b""] * len(begins)
    held = hashed[parts[0][first[begins]]] if size else np.zeros(len(begins), np.uint64)
    for c in parts[1:]:
        more = c[first[begins]]
        spelled = [b"%b %b" % (p, names[i]) for p, i in zip(spelled, more.tolist())]
        held = held * _GOLD + hashed[more]
    return spelled, _finished(held), ends, word, counts, names, hashed


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending, where each one stands, and how often."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    begin = np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1)) if len(keys) else np.zeros(0, np.int64)
    return sorted_[begin], order[begin], np.diff(np.append(begin, len(keys)))


# A stripe in transit: its next words joined by spaces, which no word holds, and their counts as ints.
_STRIPE = "lang string, prefix binary, slice int, nexts binary, counts binary"


def stripes(docs: DataFrame, size: int, frequent, cuts) -> DataFrame:
    """``(lang, prefix, slice, nexts, counts)``: the stripes that each task finds in its documents.

    ``docs`` is ``(lang, text)``, ``frequent`` the broadcast filter of frequent phrases of ``size``
    words, ``cuts`` the broadcast numbers of slices by bucket of prefix hashes. The next words of a
    stripe that is cut are dealt into its slices by their hashes.
    """

    def rows(found, own, lang):
        known = _Filter(frequent.value) if frequent is not None else None
        spelled, hashes, ends, word, counts, names, hashed = _stripes(found, own, lang, size, known)
        if not spelled:
            return
        number = cuts.value
        pieces = number[(hashes % np.uint64(len(number))).astype(np.int64)]
        of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        to = np.zeros(len(of), np.int32)
        if (pieces > 1).any():
            shares = np.where(word >= 0, hashed[np.maximum(word, 0)] >> np.uint64(8), 0)
            to = (shares % pieces[of].astype(np.uint64)).astype(np.int32)
            order = np.lexsort((to, of))
            of, to, word, counts = of[order], to[order], word[order], counts[order]
        begin = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(to, prepend=-1) != 0))
        values = pa.array([REST, *names], pa.binary())
        offsets = np.append(begin, len(of)).astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(word + 1)))
        packed = [None, pa.py_buffer(offsets * 4), pa.py_buffer(counts.astype("<i4"))]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(begin), pa.string()),
                pa.array(spelled, pa.binary()).take(pa.array(of[begin])),
                pa.array(to[begin]),
                pc.binary_join(words, b" "),
                pa.Array.from_buffers(pa.binary(), len(begin), packed),
            ],
            ["lang", "prefix", "slice", "nexts", "counts"],
        )

    def run(batches):
        for part in parts_of(batches, 1, PART):
            langs = part.column(0)
            for lang in pc.unique(langs).to_pylist():
                texts = [t for t in part.column(1).filter(pc.equal(langs, lang)).to_pylist() if t]
                if len(texts) == 1:
                    for found, own in _slices(texts[0], size, PART):
                        yield from rows(pa.array(found, pa.large_binary()), own, lang)
                elif texts:
                    yield from rows(_split(b"\n".join(texts)), None, lang)

    return docs.mapInArrow(run, _STRIPE)


def merged_stripes(found: DataFrame, least: int) -> DataFrame:
    """``(lang, prefix, next, f, hash)`` of stripes added up element by element.

    A row for each next word with ``f`` of ``least`` or more and the hash of the phrase, and one
    without ``next`` whose ``f`` is the sum of a slice: the sums of a prefix add up to the
    number of times it occurs. All slices of a stripe are added up by tasks of their own.
    """

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _unpacked(batch)
            rows = rows if held is None else pa.concat_tables([held, rows])
            rows = rows.combine_chunks()
            number = _runs(rows)
            open_ = int(np.searchsorted(number, number[-1]))
            if open_:
                yield _entries(_added_up(rows.slice(0, open_)), least)
            # The last stripe may go on in the next batch; what there is of it is added up.
            held = _as_rows(_added_up(rows.slice(open_)))
        if held is not None:
            yield _entries(_added_up(held), least)

    dealt = found.repartition("lang", "prefix", "slice").sortWithinPartitions("lang", "prefix", "slice")
    return dealt.mapInArrow(run, "lang string, prefix string, next string, f bigint, hash bigint")


def _unpacked(batch: pa.RecordBatch) -> pa.Table:
    """Stripes in transit with lists of words and of counts."""
    packed = batch.column(4)
    offsets = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    counts = np.frombuffer(packed.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<i4").astype(np.int64)
    nexts = pc.split_pattern(batch.column(3), pattern=b" ")
    nexts = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // 4), nexts.flatten())
    lists = [nexts, pa.ListArray.from_arrays(nexts.offsets, pa.array(counts))]
    return pa.Table.from_arrays([*batch.columns[:3], *lists], batch.schema.names)


def _runs(rows: pa.Table) -> np.ndarray:
    """The number of the stripe that each of the sorted rows belongs to."""
    other = np.zeros(rows.num_rows, bool)
    for name in ("lang", "prefix", "slice"):
        column = rows[name].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        other[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return other.cumsum()


def _added_up(rows: pa.Table):
    """The stripes of some whole runs of rows, merged element by element: their keys (the first row
    of each), and the number of the stripe, next word and count of each entry."""
    number = _runs(rows)
    lists, counts = rows["nexts"].combine_chunks(), rows["counts"].combine_chunks()
    lists, counts = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (lists, counts))
    of = np.repeat(number, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    size = max(1, len(words.dictionary))
    keys, _, _ = _counted(joint := of * size + words.indices.to_numpy())
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, np.searchsorted(keys, joint), counts.flatten().to_numpy())
    first = np.flatnonzero(np.diff(number, prepend=-1))
    return rows.select(["lang", "prefix", "slice"]).take(pa.array(first)), keys // size, words.dictionary.take(pa.array(keys % size)), sums


def _as_rows(merged) -> pa.Table:
    keys, of, words, sums = merged
    offsets = pa.array(np.searchsorted(of, np.arange(keys.num_rows + 1)), pa.int32())
    lists = (pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, pa.array(sums)))
    return keys.append_column("nexts", lists[0]).append_column("counts", lists[1])


def _entries(merged, least: int) -> pa.RecordBatch:
    """A row for the sum of each stripe, and for each frequent entry."""
    keys, of, words, sums = merged
    total = np.add.reduceat(sums, np.searchsorted(of, np.arange(keys.num_rows)))
    often = np.flatnonzero(sums >= least)
    named = [(i, o, w) for i, o, w in zip(often.tolist(), of[often].tolist(), words.take(pa.array(often)).to_pylist()) if w != REST]
    langs, prefixes = keys["lang"].to_pylist(), keys["prefix"].to_pylist()
    hashes = [phrase_hash([*(prefixes[o].split(b" ") if prefixes[o] else []), w], langs[o]) for _, o, w in named]
    n = keys.num_rows
    which = np.concatenate([np.arange(n), np.array([o for _, o, _ in named], np.int64)])
    chosen = keys.select(["lang", "prefix"]).take(pa.array(which)).combine_chunks()
    columns = [
        chosen["lang"].chunk(0),
        chosen["prefix"].chunk(0).cast(pa.string()),
        pa.array([None] * n + [w for *_, w in named], pa.binary()).cast(pa.string()),
        pa.array(np.concatenate([total, sums[[i for i, *_ in named]] if named else np.zeros(0, np.int64)])),
        pa.array(np.concatenate([np.zeros(n, np.int64), np.array(hashes, np.uint64).view(np.int64)])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "next", "f", "hash"])


def _frequent(entries: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the phrases' hashes: ``bits`` / 64 rows at most reach the driver."""
    shift = 64 - (bits - 1).bit_length()
    at = entries.select(F.shiftrightunsigned("hash", shift).alias("at"))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    words = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(bit).alias("b")).toArrow()
    held = np.zeros(1 << max(0, (bits - 1).bit_length() - 6), np.uint64)
    held[words["i"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return held


def _cuts(entries: DataFrame) -> np.ndarray:
    """The number of slices for each bucket of prefixes, by its most frequent one."""
    bucket = F.col("hash").bitwiseAND(F.lit(BUCKETS - 1))
    most = entries.filter(F.col("f") > SLICE).groupBy(bucket.alias("i")).agg(F.max("f").alias("f")).toArrow()
    out = np.ones(BUCKETS, np.int64)
    out[most["i"].to_numpy()] = -(-most["f"].to_numpy() // SLICE)
    return out


def count_phrases(docs: DataFrame, params: PhraseParams) -> list[DataFrame]:
    """For each length of a prefix, 0 to ``longest`` - 1 words, its merged stripes.

    Each length takes one pass over all documents. A pass counts only what the one before leaves
    possible: a phrase is frequent only if it is without its first and without its last word.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # The stripe of the empty prefix is the list of words; its occurrences are not known yet.
    frequent, cuts = None, np.full(BUCKETS, max(1, ceil(size / 8 / SLICE)), np.int64)
    out = []
    for length in range(params.longest):
        found = stripes(texts, length, frequent, spark.sparkContext.broadcast(cuts))
        level = write_scratch(merged_stripes(found, params.least), f"stripes-{length}")
        out.append(level)
        if length + 1 < params.longest:
            entries = level.filter("next is not null")
            frequent, cuts = spark.sparkContext.broadcast(_frequent(entries, params.bits)), _cuts(entries)
    return out


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams()) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best ``top`` phrases of each language.

    Texts of ``docs(lang, text)`` are cut into pieces at ``.,;:!?`` and line ends, pieces at spaces
    and tabs into words, A-Z lower-cased. ``a``, ``l`` and ``r`` are the occurrences of the phrase
    and of the two parts of its weakest cut, the one of the lowest score floor(10^6 a a / (l r)), of
    equal ones the earliest; ``n`` is the number of words of the language. Phrases inside a longer
    candidate with ``within`` % of their occurrences are left out, whether that one stays or not.
    Best first: by score, by ``a``, then by phrase in byte order.

    Sums are exact: scores are worked out in decimals of 38 digits, enough for 10^15 occurrences. A
    null text has no words, a null language is ``und``; repeated rows count each; other columns,
    whatever their names, are left out. An empty table gives an empty result.
    """
    levels = count_phrases(docs, params)
    spelled = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
    entries = [level.filter("next is not null").select("lang", spelled.alias("phrase"), "f") for level in levels]
    totals = [
        level.filter("next is null").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("f").alias("f"))
        for level in levels
    ]
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    words = F.split("phrase", " ")
    found = union(entries[1:]).select("lang", "phrase", F.col("f").alias("a"), words.alias("words"))
    # Frequencies fall with length, so the longer candidates to look at are those of one word more.
    inner = lambda begin: F.array_join(F.slice("words", begin, F.size("words") - 1), " ")
    most = (
        found.filter(F.size("words") > 2)
        .select("lang", F.col("a").alias("f"), F.explode(F.array(inner(1), inner(2))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longest"))
    )
    kept = found.join(most, ["lang", "phrase"], "left").filter(
        F.col("longest").isNull() | (100 * F.col("longest") < params.within * F.col("a"))
    )
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("rest"),
    )
    of = lambda parts, part, count: union(parts).select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    cuts = cuts.join(of(totals[1:], "first", "l"), ["lang", "first"]).join(of(entries[:-1], "rest", "r"), ["lang", "rest"])
    score = F.expr("CAST((CAST(1000000 AS DECIMAL(38,0)) * a * a) div (CAST(l AS DECIMAL(38,0)) * r) AS BIGINT)")
    weakest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    best = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # Most phrases are of few languages: they are ranked in parts first.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    for own in (Window.partitionBy("lang", part), Window.partitionBy("lang")):
        best = best.withColumn("rank", F.row_number().over(own.orderBy(*order))).filter(F.col("rank") <= params.top)
    sums = totals[0].select("lang", F.col("f").alias("n"))
    return best.join(sums, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
