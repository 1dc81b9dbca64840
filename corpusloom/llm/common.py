"""What several operators share: hash shares, the hold-out rule, text slices, union-find."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER_RUN = re.compile(r"[^\W\d_]+")
WORD_GAP = r"[ \t-\r]+"  # the white space between words: space and 0x09 to 0x0D
SLICE = 1 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a null id counts as an empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(folds))


def hash_share(key: Column, share: float | Column) -> Column:
    """True for about ``share`` of all keys, always for the same ones."""
    scale = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit("share")), F.lit(scale)) < F.lit(scale) * share


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """A text in slices cut where a letter run ends, so that a very long one needs little memory."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and (text[cut].isalpha() and text[cut - 1].isalpha()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def letter_runs(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of letters of a text, slice by slice."""
    for part in slices(text):
        yield LETTER_RUN.findall(part.lower())


class Forest:
    """Union-find over 0..n-1 that keeps only the links which joined two sets."""

    def __init__(self, n: int):
        self.parent = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def roots(self) -> np.ndarray:
        """The root of every element, all paths shortened."""
        parent = self.parent
        while True:
            up = parent[parent]
            if (up == parent).all():
                return parent
            parent[:] = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the pairs ``(a[i], b[i])``."""
        while len(a):
            roots = self.roots()
            apart = roots[a] != roots[b]
            a, b = a[apart], b[apart]
            # One link for each root now, the others after the paths have been shortened.
            low, high = np.minimum(roots[a], roots[b]), np.maximum(roots[a], roots[b])
            _, first = np.unique(high, return_index=True)
            for i in first.tolist():
                x, y = self.find(int(low[i])), self.find(int(high[i]))
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    self.kept.append((int(a[i]), int(b[i])))
