"""Words of ASCII letters, digits and all characters beyond ASCII, read from UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow.compute as pc

PART = 1 << 22  # bytes of text that are split into words at once


def _as_word_byte(c: int) -> int:
    if 0x41 <= c <= 0x5A:
        return c + 32
    return c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20


_BYTES = bytes(map(_as_word_byte, range(256)))


def terms(text: bytes | None) -> list[bytes]:
    """The runs of letters and digits of a text, A-Z lower-cased; none for null."""
    return text.translate(_BYTES).split() if text else []


def term_parts(text: bytes | None, size: int = PART) -> Iterator[list[bytes]]:
    """The same words of a long text, in parts cut between words."""
    start, text = 0, text or b""
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and _BYTES[text[cut]] != 0x20:
            cut += 1
        yield terms(text[start:cut])
        start = cut
    yield terms(text[start:])


def coded(texts: list[bytes | None], codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words of some texts in a row, -1 for a word without one, and how many words
    each text has. Words themselves are held for ``PART`` bytes of text at a time."""
    get, none = codes.get, repeat(-1)
    counts, out, at, held = np.zeros(len(texts), np.int64), [], 0, []

    def flush():
        out.append(np.fromiter(map(get, chain.from_iterable(held), none), np.int32, sum(map(len, held))))
        held.clear()

    size = 0
    for at, text in enumerate(texts):
        for part in term_parts(text):
            counts[at] += len(part)
            held.append(part)
        size += len(text or b"")
        if size > PART:
            flush()
            size = 0
    flush()
    return np.concatenate(out), counts


def parts_of(batches, column: int, size: int = PART):
    """Record batches in parts of about ``size`` bytes of text, a longer text in a part of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and held + n > size:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
