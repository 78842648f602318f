"""A two-level n-gram trie in Elias-Fano sequences: words, their successors by context, quantised probabilities.

Words are 64-bit hashes.  Level one is the rising list of context hashes; pointers, rising too, say where each context's
successors begin in level two.  There a successor is its number among the trie's words, made to rise across contexts by
adding (context number) * (number of words): finding a pair is one successor search relative to its context.  All parts
lie in one memory map.
"""

from __future__ import annotations

import mmap

import numpy as np

#: Probabilities are kept as steps of log10 between -LOWEST and 0; 0 means none.
LOWEST, STEPS = 14.0, 65534


def quantised(p: np.ndarray) -> np.ndarray:
    return (np.clip(np.round((np.log10(p) + LOWEST) / LOWEST * STEPS), 0, STEPS) + 1).astype("<u2")


def restored(codes: np.ndarray) -> np.ndarray:
    table = np.concatenate([[0.0], 10 ** (np.arange(STEPS + 1) / STEPS * LOWEST - LOWEST)])
    return table[codes]


class Rising:
    """A strictly or weakly rising sequence of unsigned numbers: low bits packed, high bits in unary."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        bits = np.unpackbits(high, bitorder="little")
        # ones before each zero: where the values of each high part begin
        zeros = np.flatnonzero(bits == 0)
        self.starts = np.concatenate([[0], zeros - np.arange(len(zeros))])

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(n, width, low words, high bytes) of the sequence."""
        n = len(values)
        values = values.astype("<u8")
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros(n * width // 64 + 2, "<u8")
        if width and n:
            at = np.arange(n, dtype="u8") * np.uint64(width)
            word, offset = (at >> np.uint64(6)).astype("i8"), at & np.uint64(63)
            part = values & np.uint64((1 << width) - 1)
            np.bitwise_or.at(low, word, part << offset)
            over = offset + np.uint64(width) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - offset[over]))
        bits = np.zeros((top >> width) + n + 1, "u1")
        bits[(values >> np.uint64(width)).astype("i8") + np.arange(n)] = 1
        return n, width, low, np.packbits(bits, bitorder="little")

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), "u8")
        at = i.astype("u8") * np.uint64(self.width)
        word, offset = (at >> np.uint64(6)).astype("i8"), at & np.uint64(63)
        value = self.low[word] >> offset
        over = offset > 0
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - offset[over])
        return value & np.uint64((1 << self.width) - 1)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where each of ``x`` stands in the sequence, -1 for one that does not."""
        x = x.astype("u8")
        high = np.minimum(x >> np.uint64(self.width), np.uint64(len(self.starts) - 1)).astype("i8")
        at, end = self.starts[high], self.starts[np.minimum(high + 1, len(self.starts) - 1)]
        end = np.where(high + 1 < len(self.starts), end, self.n)
        wanted = x & np.uint64((1 << self.width) - 1)
        found = np.full(len(x), -1, "i8")
        left = np.flatnonzero((at < end) & (x >> np.uint64(self.width) == high.astype("u8")))
        # halving, as a frequent context has many values with the same high part
        while len(left):
            middle = (at[left] + end[left]) // 2
            value = self.low_of(middle)
            hit = value == wanted[left]
            found[left[hit]] = middle[hit]
            above = value < wanted[left]
            at[left[above]] = middle[above] + 1
            end[left[~above]] = middle[~above]
            left = left[~hit]
            left = left[at[left] < end[left]]
        return found

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at ``i``."""
        bits = np.unpackbits(self.high, bitorder="little")
        ones = np.flatnonzero(bits)[: self.n]
        return ((ones[i] - i).astype("u8") << np.uint64(self.width)) | self.low_of(np.asarray(i))


class Trie:
    """Levels of one trie in one memory map; built from pairs of hashes with the probability of each."""

    def __init__(self, contexts: np.ndarray, words: np.ndarray, probabilities: np.ndarray):
        self.n_words = 0
        names, context_no = np.unique(contexts, return_inverse=True)
        vocabulary, word_no = np.unique(words, return_inverse=True)
        self.n_words = max(1, len(vocabulary))
        relative = context_no.astype("u8") * np.uint64(self.n_words) + word_no.astype("u8")
        order = np.argsort(relative, kind="stable")
        pointers = np.concatenate([[0], np.cumsum(np.bincount(context_no, minlength=len(names)))])
        parts = [Rising.encode(v) for v in (names, vocabulary, pointers, relative[order])]
        arrays = [a for p in parts for a in p[2:]] + [quantised(probabilities[order])]
        places, at = [], 0
        for a in arrays:
            places.append(at)
            at += (a.nbytes + 7) // 8 * 8
        self.bytes = at
        self.map = mmap.mmap(-1, max(8, at))
        held = []
        for a, place in zip(arrays, places, strict=True):
            self.map[place : place + a.nbytes] = a.tobytes()
            held.append(np.frombuffer(self.map, a.dtype, len(a), place))
        self.contexts, self.words, self.pointers, self.pairs = (
            Rising(p[0], p[1], held[2 * i], held[2 * i + 1]) for i, p in enumerate(parts)
        )
        self.codes = held[-1]

    def __call__(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The quantised probability of each pair, 0 where the trie has none."""
        out = np.zeros(len(contexts), "<u2")
        names, back = np.unique(contexts, return_inverse=True)
        c = self.contexts.find(names)[back]
        names, back = np.unique(words, return_inverse=True)
        w = self.words.find(names)[back]
        known = np.flatnonzero((c >= 0) & (w >= 0))
        at = self.pairs.find(c[known].astype("u8") * np.uint64(self.n_words) + w[known].astype("u8"))
        out[known[at >= 0]] = self.codes[at[at >= 0]]
        return out
