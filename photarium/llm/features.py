"""Words and character grams of many texts as numpy arrays."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[128:] = True
GRAM = 5
_SLOTS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(64)], dtype=np.uint64)


class Words:
    """Words (runs of letters; bytes above 127 count as letters) of ``texts``.

    ``doc`` and ``hash`` have an entry for each word; ``gram_hash`` and
    ``gram_word`` one for each run of five bytes inside the word and the mark
    before it. Texts are lower-cased.
    """

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode("utf-8", "replace") for t in texts]
        flat = np.frombuffer(b"\n".join([b"", *raw, b"\n" * GRAM]), dtype=np.uint8)
        letter = LETTER[flat]
        flat = np.where(letter, flat, 94)
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        start, stop = edge[0::2], edge[1::2]
        bounds = np.cumsum([1, *(len(r) + 1 for r in raw)])
        self.doc = np.searchsorted(bounds, start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))[: len(texts)]
        if not len(start):
            self.hash = self.gram_hash = np.zeros(0, np.uint64)
            self.gram_word = np.zeros(0, np.int64)
            return
        at = np.flatnonzero(letter)
        word_of = np.repeat(np.arange(len(start)), stop - start)
        place = np.minimum(at - start[word_of], 63)
        first = np.concatenate([[0], np.cumsum(stop - start)[:-1]])
        self.hash = np.add.reduceat((flat[at].astype(np.uint64) + np.uint64(1)) * _POWERS[place], first) * _MIX
        # grams start at the mark before a word or inside it and end inside it
        length = stop - start
        n = np.maximum(length + 2 - GRAM, 0)
        self.gram_word = np.repeat(np.arange(len(start)), n)
        origin = np.repeat(start - 1 - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        h = flat[origin].astype(np.uint64)
        for k in range(1, GRAM):
            h = h << np.uint64(8) | flat[origin + k]
        self.gram_hash = h * _MIX


class Vocabulary:
    """Hash to row number (from 1; 0: unknown) through a table of 2**20 slots."""

    def __init__(self, hashes: np.ndarray):
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.hashes = np.concatenate([np.zeros(1, np.uint64), hashes[np.sort(first)]])
        self.kept = np.sort(first)
        self.table = np.zeros(1 << _SLOTS, dtype=np.int32)
        self.table[(self.hashes[1:] >> np.uint64(64 - _SLOTS)).astype(np.int64)] = np.arange(1, len(self.hashes))

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        row = self.table[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)]
        return np.where(self.hashes[row] == hashes, row, 0)
