"""Positions of records in text files, for formats where the order of lines matters.

Rows of a scan, and of a sorted partition, come in order. The functions below walk them in that order
and carry a little state from batch to batch; only the narrow columns they are given leave the JVM.
They are nested so that they travel with their code: executors need not have this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_positioned(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """Text records as ``(file, position, value)``; positions ascend within a file.

    A position is the offset of the split in its file and the running number inside the scan task.
    Both come with the scan, so numbering costs neither a sort nor a shuffle.
    """
    reader = spark.read
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), _position().alias("position"), "value"
    )


def _position() -> Column:
    return F.struct(
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("row"),
    )


def opens_file(file: Column, split_start: Column) -> Column:
    """Whether a record of a scan is the first one of its file.

    The first record lies in the split that begins at 0, and the rows of a split follow each
    other. It can only be used directly above a scan. A path must not be listed twice.
    """

    @F.pandas_udf("boolean")
    def first(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        before = None
        for files, starts in parts:
            files = files.to_numpy()
            changed = np.ones(len(files), dtype=bool)
            if len(files):
                changed[1:] = files[1:] != files[:-1]
                changed[0] = before is None or files[0] != before
                before = files[-1]
            yield pd.Series(changed & (starts.to_numpy() == 0))

    return first.asNondeterministic()(F.xxhash64(file), split_start)


def running_count(key: Column, flag: Column) -> Column:
    """How many of the rows so far with the same ``key`` have the ``flag``, in a partition sorted by key."""

    @F.pandas_udf("bigint")
    def count(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        before, carried = None, 0
        for keys, flags in parts:
            keys, total = keys.to_numpy(), flags.to_numpy(dtype=np.int64).cumsum()
            if not len(keys):
                yield pd.Series(total)
                continue
            starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            reset = np.zeros(len(keys), dtype=np.int64)
            reset[starts] = total[starts - 1]
            total = total - np.maximum.accumulate(reset)
            if before is not None and keys[0] == before:
                total[: starts[0] if len(starts) else len(keys)] += carried
            before, carried = keys[-1], int(total[-1])
            yield pd.Series(total)

    return count.asNondeterministic()(F.xxhash64(key), flag)


def walk_states(split: Column, outside: Column, inside: Column) -> Column:
    """``struct<o, i, no, ni>`` for the pieces of a scan, each of which leads from one state to another.

    ``outside`` and ``inside`` say whether a piece that begins outside, or inside, a quotation ends
    inside one. ``o`` and ``i`` are whether the piece begins inside if its split began outside, or
    inside; ``no`` and ``ni`` how many pieces of the split so far, itself included, began outside.
    """

    @F.pandas_udf("o boolean, i boolean, no bigint, ni bigint")
    def walk(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        before, states, counts = None, [False, True], [0, 0]
        for splits, out, into in parts:
            splits, n = splits.to_numpy(), len(splits)
            a, b = out.to_numpy(dtype=bool), into.to_numpy(dtype=bool)
            opens = np.ones(n, dtype=bool)
            if n:
                opens[1:] = splits[1:] != splits[:-1]
                opens[0] = before is None or splits[0] != before
            # A piece that ends alike from either state fixes it; between such pieces others swap it.
            fixes, swaps = a == b, a & ~b
            swapped = np.concatenate([[0], swaps[:-1].cumsum()])[:n]
            known = opens.copy()
            known[1:] |= fixes[:-1]
            known[:1] = True
            last = np.maximum.accumulate(np.where(known, np.arange(n), 0))
            columns = {}
            for h, names in enumerate((("o", "no"), ("i", "ni"))):
                base = np.concatenate([[False], a[:-1]])[:n]
                base[opens] = bool(h)
                if n and not opens[0]:
                    base[0] = states[h]
                state = base[last] ^ ((swapped - swapped[last]) % 2 == 1)
                began = (~state).astype(np.int64).cumsum()
                reset = np.zeros(n, dtype=np.int64)
                reset[1:][opens[1:]] = began[:-1][opens[1:]]
                began = began - np.maximum.accumulate(reset) if n else began
                if n and not opens[0]:
                    first = np.flatnonzero(opens)
                    began[: first[0] if len(first) else n] += counts[h]
                if n:
                    states[h], counts[h] = bool(b[-1] if state[-1] else a[-1]), int(began[-1])
                columns[names[0]], columns[names[1]] = state, began
            if n:
                before = splits[-1]
            yield pd.DataFrame(columns)[["o", "i", "no", "ni"]]

    return walk.asNondeterministic()(split, outside, inside)
