"""Words, word hashes and run fingerprints, vectorised over Arrow batches of texts.

*Words*: markup ``<...>`` becomes a blank, invisible characters go, NFKC, lower case; the longest
runs of Unicode letters and digits.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

MARKUP = re.compile(r"<[^<>]*>")
INVISIBLE = re.compile("[​‌‍⁠﻿­]")
WORD = re.compile(r"[^\W_]+")

#: Odd multiplier of the run fingerprints, its inverse modulo 2**64, and the mixer's factors (fixed values).
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def normalise(text: str) -> str:
    if "<" in text:
        text = MARKUP.sub(" ", text)
    if not text.isascii():
        if INVISIBLE.search(text):
            text = INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", text)
    return text.lower()


def words(text: str | None) -> list[str]:
    return WORD.findall(normalise(text)) if text else []


class WordHashes(dict):
    """Word -> 64-bit hash, filled as words come and emptied when it has grown to ``most`` entries."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    y = x >> np.uint64(30)
    y ^= x
    y *= MIX_A
    y ^= y >> np.uint64(27)
    y *= MIX_B
    y ^= y >> np.uint64(31)
    return y


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def run_fingerprints(hashes: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``k`` words of each text.

    ``hashes`` are the word hashes of all texts in a row, ``lengths`` their word counts. Returns
    (fingerprint, number of the text, position of the run in it), in order of text and position.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    total = len(hashes)
    runs = np.maximum(lengths - k + 1, 0)
    if not runs.sum():
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(total + 1)
    sums = np.zeros(total + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:total], out=sums[1:])
    owner = np.repeat(np.arange(len(lengths)), runs)
    first_run = np.concatenate(([0], np.cumsum(runs)[:-1]))
    position = np.arange(runs.sum()) - first_run[owner]
    at = np.concatenate(([0], np.cumsum(lengths)[:-1]))[owner] + position
    return mix((sums[at + k] - sums[at]) * down[at]), owner, position


def first_of_each(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Indices of the first occurrence of every (owner, key), ascending; the pairs are told apart by a 64-bit mix of both."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    both = mix(keys + owner.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(both)
    both = both[order]
    return np.sort(np.minimum.reduceat(order, np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))))


def batches(batch_texts: list[str | None], most_chars: int = 4_000_000):
    """Slices (start, end) of a batch with about ``most_chars`` code points each; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(batch_texts):
        n = len(text) if text else 0
        if size and size + n > most_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(batch_texts):
        yield start, len(batch_texts)
