"""Words of many texts at once, as hashes: runs of letters, lower-cased character by character."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from kinora.llm.batches import mix64

_FACTOR = np.uint64(0xD1342543DE82EF95)


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(1)
def lowered() -> np.ndarray:
    """A 64-bit value for each code point, the same for a letter's two cases."""
    lower = np.arange(0x110000, dtype=np.uint64)
    for c in range(0x110000):
        if len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    return mix64((lower + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(1)
def _powers() -> np.ndarray:
    return np.multiply.accumulate(np.full(1 << 12, _FACTOR, dtype=np.uint64))


def hashed_words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the number of the text it stands in, in order."""
    inside = np.zeros(len(points) + 2, dtype=bool)
    inside[1:-1] = letters()[points]
    edge = inside[1:] & ~inside[:-1]
    over = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(points))]
    cut = cut[inside[cut] & inside[cut + 1]]
    edge[cut] = over[cut] = True
    starts, ends = np.flatnonzero(edge), np.flatnonzero(over)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lengths = ends - starts
    within = np.arange(len(points)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(points)]])))
    values = np.append(lowered()[points] * _powers()[within & 0xFFF], np.uint64(0))
    hashes = np.add.reduceat(values, np.ravel(np.column_stack([starts, ends])))[::2]
    return mix64(hashes ^ lengths.astype(np.uint64)), np.searchsorted(offsets, starts, side="right") - 1


def gram_features(points: np.ndarray, offsets: np.ndarray, bits: int, skips: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words, word pairs and pairs that skip up to ``skips`` words, with the text each comes from."""
    words, text = hashed_words(points, offsets)
    found, where = [words], [text]
    for gap in range(1, 2 + skips):
        near = text[gap:] == text[:-gap] if len(text) > gap else np.zeros(0, dtype=bool)
        found.append(mix64(words[:-gap][near] * _FACTOR + mix64(words[gap:][near] + np.uint64(gap))) if near.any() else words[:0])
        where.append(text[gap:][near] if near.any() else text[:0])
    return (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(where)
