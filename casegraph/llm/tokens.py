"""Token ids of whole texts by a public tokenizer, word by word with a cache of words."""

from __future__ import annotations

import os

import numpy as np

from .common import binary_column
from .words import is_space, lower_ascii, split_words

_CODECS: dict[str, "WordTokenizer"] = {}
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!\"#$%&'()*+,-./:;=?@[\\]^_`{}~")] = True  # not those of "<|" and of the separator
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = True


class WordTokenizer:
    """Ids of texts under a lower-casing tokenizer whose tokens never cross white space.

    The text's ids are then the ids of its words in order, so each distinct word is encoded once and kept; marks
    behind an ASCII letter at a word's end are a word of their own, and A-Z are lower-cased before the look-up (not in
    buffers with "<|", where special tokens may stand). At most max_words words are kept at a time. The tokenizer
    file must exist at the same path on every executor. Spark's tasks share the cores, so it runs in one thread.
    """

    #: Stands between words that are encoded as one text; words that hold it are encoded each for itself.
    BAR = "|"

    def __init__(self, path: str, max_words: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)  # for words of a-z, which the whole tokenizer leaves as they are
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.max_words = max_words
        self.bar = self.tokenizer.encode(self.BAR, add_special_tokens=False).ids
        self.joins = len(self.bar) == 1
        self._forget()

    def _forget(self) -> None:
        """Keep the words that several buffers had, or none if those alone are too many."""
        often = np.flatnonzero(self.hits > 1) if hasattr(self, "hits") else np.zeros(0, np.int64)
        if len(often) > self.max_words // 2:
            often = often[:0]
        words = list(self.row) if len(often) else []
        starts = np.cumsum(self.counts) - self.counts if len(often) else often
        table = [self.table[starts[i] : starts[i] + self.counts[i]] for i in often]
        self.row: dict[bytes, int] = {words[i]: k for k, i in enumerate(often)}
        self.counts = self.counts[often] if len(often) else np.zeros(0, np.int64)
        self.table = np.concatenate(table) if table else np.zeros(0, np.uint32)
        self.hits = np.ones(len(often), np.int64)

    @classmethod
    def at(cls, path: str) -> "WordTokenizer":
        """One for each path and Python worker."""
        if path not in _CODECS:
            _CODECS[path] = cls(path)
        return _CODECS[path]

    def _ids(self, words: list[str], kind: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each word). Words of a-z (kind 0) are encoded as one text: each ends with an end-of-word token.
        Others without a bar (1) too, with a bar between them, whose id no other word has; the rest (2) one by one."""
        encode = lambda tokenizer, texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if kind == 0:
            ids = np.array(encode(self.plain, [" ".join(words)])[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        if kind < 2 and self.joins:
            ids = np.array(encode(self.tokenizer, [f" {self.BAR} ".join(words)])[0].ids, np.uint32)
            bars = np.flatnonzero(ids == self.bar[0])
            if len(bars) == len(words) - 1:
                return np.delete(ids, bars), np.diff(bars, prepend=-1, append=len(ids)) - 1
        each = [e.ids for e in encode(self.tokenizer, words)]
        return np.array([i for x in each for i in x], np.uint32), np.fromiter(map(len, each), np.int64, len(each))

    def _learn(self, words: list[bytes]) -> None:
        kinds: tuple[list[bytes], ...] = ([], [], [])
        for w in words:
            kinds[0 if w.isalpha() and w.islower() else 2 if b"|" in w else 1].append(w)
        found = [self._ids([w.decode("utf-8", "replace") for w in of[at : at + 256]], k) for k, of in enumerate(kinds) for at in range(0, len(of), 256)]
        self.row.update(zip((w for of in kinds for w in of), range(len(self.row), len(self.row) + len(words)), strict=True))
        self.table = np.concatenate([self.table, *(x[0] for x in found)])
        self.counts = np.concatenate([self.counts, *(x[1] for x in found)])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, n + 1 offsets) of an Arrow string column; null is empty."""
        import pyarrow as pa

        data, offsets = binary_column(texts)
        starts, ends, before = split_words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kept = data[int(offsets[0]) : int(offsets[-1])]
        letters = kept[~is_space(kept)]
        if b"<|" not in letters.tobytes():
            letters = lower_ascii(letters)
        stops = np.cumsum(ends - starts)
        # where up to 16 marks follow an ASCII letter up to the word's end: that letter's place
        first, last = starts - int(offsets[0]), ends - 1 - int(offsets[0])
        tail = np.flatnonzero(_MARK[kept[last]])
        letter = last[tail]
        for _ in range(16):
            letter = letter - (_MARK[kept[letter]] & (letter > first[tail]))
        good = _LETTER[kept[letter]]
        marked = np.zeros(len(starts), dtype=bool)
        marked[tail[good]] = True
        cut = np.zeros(len(letters) + 1, dtype=bool)
        cut[0] = cut[stops] = cut[stops[tail[good]] - (last[tail[good]] - letter[good])] = True
        bounds = np.flatnonzero(cut)
        extra = np.concatenate([[0], np.cumsum(marked)])
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(letters)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.row]
        if len(self.row) + len(new) > self.max_words:
            self._forget()
            new = [w for w in distinct if w not in self.row]
        self._learn(new)
        rows = np.fromiter((self.row[w] for w in distinct), np.int64, len(distinct))
        self.hits[rows] += 1
        rows = rows[words.indices.to_numpy(zero_copy_only=False)]
        at = np.cumsum(self.counts) - self.counts
        n = self.counts[rows]
        total = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(int(total[-1]), dtype=np.int64) + np.repeat(at[rows] - total[:-1], n)
        return self.table[index], total[before + extra[before]]
