"""Word shingles of many texts at once: hashes of the distinct 5-word sequences of each text."""

from __future__ import annotations

import numpy as np

from ledgertide.llm.common import mix, random_words, range_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = random_words(11, 64) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of texts laid end to end, A-Z lower-cased, and n + 1 word offsets by text."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return range_hashes(_LOWER[data], start, end), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, laid end to end, and their n + 1 offsets.

    A text with fewer words has one shingle, its whole sequence; a text without words has none.
    """
    hashes, at = word_hashes(data, offsets)
    many = max(0, len(hashes) - words + 1)
    rolled = np.full(many, np.uint64(words), np.uint64)
    for j in range(words):
        rolled += hashes[j : j + many] * _STEP[j]
    rolled = mix(rolled)
    sets, n = [], np.zeros(len(offsets), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = mix((hashes[a:b] * _STEP[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            continue
        sets.append(own)
        n[i + 1] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum(n)
