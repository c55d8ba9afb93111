"""Sets of word shingles of texts as sorted 64-bit hashes, computed over whole Arrow buffers."""

from __future__ import annotations

import numpy as np

from .common import binary_column, mix
from .words import lower_ascii, split_words

_rng = np.random.default_rng(20240229)
#: A random number for each byte.
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
#: Running sums of what other operators compare by ranges take the powers of one odd base.
_BASE = int(_rng.integers(0, 2**63)) * 2 + 1
_POWERS: dict[str, np.ndarray] = {}
_PLACES: list[np.ndarray] = [np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, 1 << 18)
        inverse = pow(_BASE, -1, 2**64)
        for name, base in (("up", _BASE), ("down", inverse)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step)
    return _POWERS["up"], _POWERS["down"]


def places(n: int) -> np.ndarray:
    """A random odd number for each of the first n places of a word."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    return _PLACES[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words from starts to ends in data, A-Z lower-cased: the sum of the numbers of byte and place
    multiplied. Places have numbers of their own, not powers of one base, so no pattern of letters cancels itself out:
    two different words, however long, share a hash with a chance of about 2^-64."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    at = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    letters = _BYTE[lower_ascii(data[place + np.repeat(starts, sizes)])]
    letters *= places(int(sizes.max()))[place]
    return mix(np.add.reduceat(letters, at) + sizes.astype(np.uint64))


def shingle_sets(texts, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 offsets): for each row of an Arrow string column its distinct shingles, sorted.

    A-Z are lower-cased; words are runs without space, \\t, \\n, \\v, \\f, \\r. A text of fewer words than a shingle has
    its whole sequence as the only one; without words the set is empty. Two different shingles share a hash with a
    chance of about 2^-64, whatever their pattern.
    """
    data, offsets = binary_column(texts)
    starts, ends, before = split_words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = word_hashes(data, starts, ends)
    odd = [np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1) for k in range(1, words + 1)]
    many = len(word) - words + 1
    rolled = mix(sum(word[k : k + many] * odd[k] for k in range(words))) if many > 0 else np.zeros(0, np.uint64)
    out, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            if len(own) > 1:
                fresh = np.empty(len(own), dtype=bool)
                fresh[0] = True
                np.not_equal(own[1:], own[:-1], out=fresh[1:])
                own = own[fresh]
        elif b > a:
            short = sum(word[a + k : a + k + 1] * odd[k] for k in range(b - a))
            own = mix(short + np.uint64(b - a))
        else:
            continue
        out.append(own)
        counts[i] = len(own)
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])
