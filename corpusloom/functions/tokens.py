"""Column expressions over token arrays. None of them needs a shuffle."""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom import config as C
from corpusloom.functions.text import _col, ColumnOrName

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
ALPHABETIC = r"^\p{L}+\z"


def tokenize(text: ColumnOrName, pattern: str = C.TOKEN_PATTERN, lowercase: bool = True) -> Column:
    """All matches of ``pattern``, from lower-cased text unless told otherwise."""
    text = F.lower(_col(text)) if lowercase else _col(text)
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), _no_words())


def _no_words() -> Column:
    return F.array().cast("array<string>")


def joined_tokens(text: ColumnOrName, lowercase: bool = True) -> Column:
    """Matches taken from the text as it is, joined by spaces, lower-cased afterwards."""
    joined = F.array_join(tokenize(text, lowercase=False), " ")
    return F.lower(joined) if lowercase else joined


def alphabetic_only(tokens: ColumnOrName) -> Column:
    """Keep tokens made of letters only."""
    return F.filter(_col(tokens), lambda t: t.rlike(ALPHABETIC))


def split_hyphens(tokens: ColumnOrName) -> Column:
    """Break hyphenated tokens into their parts."""
    parts = F.flatten(F.transform(_col(tokens), lambda t: F.split(t, "-")))
    return F.filter(parts, lambda t: t != "")


def without_words(tokens: ColumnOrName, words: Iterable[str]) -> Column:
    """Drop the given words whatever their case; repeated tokens stay repeated.

    The list becomes a hash set in the plan, so a token costs one probe.
    """
    listed = sorted({w.lower() for w in words if w is not None})
    if not listed:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~F.lower(t).isin(listed))


class InlineLookup:
    """A bounded (key, value) table written into the expression as an array of small maps.

    Spark searches a map literal from front to back, so one large map would cost as many
    comparisons as it has entries. Spread over buckets by hash, a key meets about two.
    """

    def __init__(self, lookup: DataFrame, key: str, value: str, rows: int):
        self.buckets = max(1, rows // 2)
        keyed = lookup.select(
            F.pmod(F.xxhash64(key), F.lit(self.buckets)).alias("b"),
            F.col(key).alias("k"),
            F.col(value).alias("v"),
        )
        maps: list[dict[str, str]] = [{} for _ in range(self.buckets)]
        for row in keyed.collect():
            maps[row["b"]][row["k"]] = row["v"]
        self._literal = json.dumps(maps, ensure_ascii=False)

    def get(self, key: Column) -> Column:
        table = F.from_json(F.lit(self._literal), "array<map<string,string>>")
        return F.get(table, F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int"))[key]


class FormFilter:
    """A Bloom filter over the keys of a table, broadcast and tested by Arrow in batches of hashes.

    It has 16 bits a key, ``MAX_BITS`` (2 MB) at most: beyond 131,072 keys a growing share of other keys
    passes, up to all of them. Nothing is ever missed, so a test may only save work. The plan names it
    and does not hold it, as the driver writes every plan out, and again for each stage that ends.
    """

    MAX_BITS = 1 << 24

    def __init__(self, lookup: DataFrame, key: str, rows: int):
        self.bits = min(self.MAX_BITS, 1 << max(6, (16 * rows - 1).bit_length()))
        self.probes = max(1, min(4, round(0.7 * self.bits / max(1, rows))))
        held = lookup.select(F.explode(F.array(*self._places(F.col(key)))).alias("at"))
        words = held.groupBy(F.shiftright("at", 6).alias("i")).agg(
            F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("b")
        )
        array, found = np.zeros(self.bits // 64, dtype=np.int64), words.toArrow()  # one row for each long at most
        array[found["i"].to_numpy()] = found["b"].to_numpy()
        self._shared = lookup.sparkSession.sparkContext.broadcast(array)

    def _places(self, key: Column) -> list[Column]:
        hashed = F.xxhash64(key)
        low, step = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32).bitwiseOR(F.lit(1))
        return [(low + step * j).bitwiseAND(F.lit(self.bits - 1)) for j in range(self.probes)]

    def _test(self):
        shared, bits, probes = self._shared, self.bits, self.probes

        def test(hashes: pa.Array) -> pa.Array:
            hashed, array = hashes.fill_null(0).to_numpy(zero_copy_only=False), shared.value
            low, step = hashed & 0xFFFFFFFF, ((hashed >> 32) & 0xFFFFFFFF) | 1
            out = np.ones(len(hashed), dtype=bool)
            for j in range(probes):
                at = (low + step * j) & (bits - 1)
                out &= (array[at >> 6] >> (at & 63)) & 1 == 1
            return pa.array(out, mask=hashes.is_null().to_numpy(zero_copy_only=False))

        return test

    def may_hold(self, key: Column) -> Column:
        """False only for keys that the table does not have; null for null."""
        test = self._test()

        @F.arrow_udf("boolean")
        def tested(hashes: pa.Array) -> pa.Array:
            return test(hashes)

        return tested(F.when(key.isNotNull(), F.xxhash64(key)))

    def may_hold_each(self, keys: Column) -> Column:
        """``may_hold`` of each element of an array; null for a null array."""
        test, same_lists = self._test(), _lists()

        @F.arrow_udf("array<boolean>")
        def tested(lists: pa.Array) -> pa.Array:
            return same_lists(lists, test(lists.flatten()))

        return tested(F.transform(keys, lambda key: F.when(key.isNotNull(), F.xxhash64(key))))


def _lists():
    """``same_lists``, nested so that tasks get its code and need not have this package."""

    def same_lists(lists: pa.Array, values: pa.Array) -> pa.Array:
        """``values`` in lists of the sizes of ``lists``. Null rows may hide values, which ``flatten`` leaves out."""
        import pyarrow.compute as pc

        ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
        return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null())

    return same_lists


def replaced_forms(tokens: ColumnOrName, lookup: DataFrame) -> Column:
    """Tokens found in ``lookup(form, lemma)`` replaced, the others as they are; one row a form.

    The table is broadcast, so it must be within the broadcast limits; it is probed by Arrow, one batch
    of rows at a time. No token leaves its row.
    """
    shared = lookup.sparkSession.sparkContext.broadcast(lookup.select("form", "lemma").toArrow().combine_chunks())
    same_lists = _lists()

    @F.arrow_udf("array<string>")
    def replaced(lists: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        table = shared.value
        words = lists.flatten()
        at = pc.index_in(words, value_set=table["form"].cast(words.type), skip_nulls=True)
        return same_lists(lists, pc.coalesce(pc.take(table["lemma"].cast(words.type).combine_chunks(), at), words))

    return replaced(_col(tokens))


def count_terms(tokens: ColumnOrName) -> Column:
    """Distinct tokens with their counts: ``array<struct<term, tf>>``, NULL for no tokens.

    Sort, find the last position of each run, subtract neighbouring positions. A document is
    counted inside its own row, where grouping by (document, term) would shuffle the corpus.
    """

    def runs(words: Column) -> Column:
        ends = F.filter(
            F.sequence(F.lit(1), F.size(words)),
            lambda i: (i == F.size(words)) | (F.get(words, i - 1) != F.get(words, i)),
        )
        return _let(
            ends,
            lambda last: F.transform(
                last,
                lambda end, k: F.struct(
                    F.get(words, end - 1).alias("term"),
                    (end - F.coalesce(F.get(last, k - 1), F.lit(0))).cast("bigint").alias("tf"),
                ),
            ),
        )

    return F.when(F.size(_col(tokens)) > 0, _let(F.sort_array(_col(tokens)), runs))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
