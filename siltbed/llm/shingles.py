"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from siltbed.llm.arrays import LOWER, blank_words, mix, span_hashes

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their n+1 offsets by text.

    A text with fewer words than a shingle has its whole sequence as one; a text
    without words has none. Two sequences are taken as equal if their 64-bit hashes are.
    """
    data = LOWER[data]
    starts, ends, by_text = blank_words(data, offsets)
    h = span_hashes(data, starts, ends)
    n = np.diff(by_text)
    text_of = np.repeat(np.arange(len(n)), n)
    if len(h) >= words:
        whole = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            whole = mix(whole * _STEP + h[k : len(h) - words + 1 + k])
        inside = text_of[: len(whole)] == text_of[words - 1 :]
        values, owner = whole[inside], text_of[: len(whole)][inside]
    else:
        values, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < words))
    if len(few):
        acc, left = np.zeros(len(few), np.uint64), np.arange(len(few))
        for k in range(words - 1):
            left = left[n[few[left]] > k]
            acc[left] = mix(acc[left] * _STEP + h[by_text[few[left]] + k])
        acc = mix(acc ^ (n[few].astype(np.uint64) * _STEP))  # differs from any full shingle
        values, owner = np.concatenate([values, acc]), np.concatenate([owner, few])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def set_keys(values: np.ndarray, by_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify each text's set, as two arrays."""
    n = np.diff(by_text)
    out = []
    for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(seed)), out=total[1:])
        out.append(mix(total[by_text[1:]] - total[by_text[:-1]] + n.astype(np.uint64) * _STEP))
    return out[0], out[1]


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted distinct arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
