"""Words of Arrow text columns, found with numpy over whole buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import SPACES, binary_column, release_memory

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def row_ranges(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together; a larger row stands alone."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches, col: str, limit: int = 2 << 20):
    """Record batches cut so that each holds at most limit bytes of text in col."""
    for batch in batches:
        _, offsets = binary_column(batch.column(col))
        for a, b in row_ranges(np.diff(offsets), limit):
            yield batch.slice(a, b - a)
    release_memory()


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words before each row) of the words in the rows that offsets cut data into."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    word = ~_IS_SPACE[data[lo:hi]]
    n = hi - lo
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets - lo] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | cut[1:n]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:n]
    starts = np.flatnonzero(starts) + lo
    return starts, np.flatnonzero(ends) + lo + 1, np.searchsorted(starts, offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return _LOWER[data]


def is_space(data: np.ndarray) -> np.ndarray:
    """Which bytes separate words."""
    return _IS_SPACE[data]
