"""A compressed full-text index over integer symbols: wavelet matrix, backward search, matching statistics."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Bit planes of a symbol sequence, most significant first, packed 64 to a word with rank counts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes = []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            zeros = len(bit) - int(bit.sum())
            self.planes.append((level, words, before, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.planes:
            word, rest = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << rest) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & mask)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place; ``first`` is where its block begins."""
        return self._walk(symbols, at) - first[symbols]

    def starts(self, alphabet: int) -> np.ndarray:
        return self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))


class FMIndex:
    """Index of a text of symbols; 0 separates its parts and belongs to no pattern.

    Suffixes are ordered by their first ``depth`` symbols, which is all that patterns of at most
    that length need: ranks count suffixes below a pattern, whatever the order among equals.
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.size = text, len(text)
        rank = text.astype(np.int64)
        span = 1
        while span < depth:
            after = np.zeros_like(rank)
            after[:-span] = rank[span:]
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1]
            span *= 2
        self.order = np.argsort(rank, kind="stable")
        self.alphabet = int(text.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.alphabet))])
        self.tree = WaveletMatrix(text[self.order - 1], max(1, (self.alphabet - 1).bit_length()))
        self.first = self.tree.starts(self.alphabet)

    def search(self, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the text's own windows of ``length`` symbols.

        (matched, low, high): how many of a window's last symbols were matched before its interval came
        down to the one place it was taken from, and the interval of suffixes at that point.
        """
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        matched = np.full(len(starts), length, np.int64)
        open_ = np.arange(len(starts))
        for done in range(length):
            symbols = self.text[starts[open_] + length - 1 - done]
            base = self.before[symbols]
            low[open_] = base + self.tree.rank(symbols, low[open_], self.first)
            high[open_] = base + self.tree.rank(symbols, high[open_], self.first)
            alone = high[open_] - low[open_] == 1
            matched[open_[alone]] = done + 1
            open_ = open_[~alone]
        return matched, low, high
