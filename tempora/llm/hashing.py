"""64-bit hashes of words and word shingles, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at a time (one longer text is taken alone).
CHUNK_BYTES = 1_000_000

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that separate words: ASCII white space alone, or all ASCII but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATED = np.zeros(256, bool)
PUNCTUATED[:128] = [not chr(i).isalnum() for i in range(128)]


def word_hashes(data: np.ndarray, ends: np.ndarray, gaps: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of texts laid end to end, and how many words each text has.

    data: bytes; ends: where each text ends. A byte's share of a word's hash depends on the byte and its place in the word.
    """
    inside = ~gaps[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cuts = ends[:-1][ends[:-1] < len(data)]
    starts[cuts] = inside[cuts]
    first = np.flatnonzero(starts)
    at = np.flatnonzero(inside)
    if not len(first):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    word = np.cumsum(starts)[at] - 1
    place = (at - first[word]).astype(np.uint64)
    share = mix((LOWER[data[at]].astype(np.uint64) + (place << np.uint64(8)) + np.uint64(1)) * _GOLD)
    bounds = np.searchsorted(at, first)
    hashes = mix(np.add.reduceat(share, bounds) + _GOLD)
    return hashes, np.diff(np.searchsorted(first, ends), prepend=0)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts of CHUNK_BYTES at most, or one text: the first one's number, their bytes and where each ends. Nulls are empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, the whole sequence of a shorter text; how many each text has."""
    factors = mix(np.arange(1, width + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    ends = np.cumsum(counts)
    begins = ends - counts
    total = len(words)
    acc = np.zeros(total, np.uint64)
    for k in range(width):
        acc[: max(total - k, 0)] += words[k:] * factors[k]
    text = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(total) + width <= ends[text]
    out, n = mix(acc[keep]), np.maximum(counts - width + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        lengths = counts.astype(np.uint64) * _GOLD
        whole = [mix((words[begins[i] : ends[i]] * factors[: counts[i]]).sum(dtype=np.uint64, keepdims=True) + lengths[i : i + 1])[0] for i in short]
        n = n.copy()
        out = np.insert(out, (np.cumsum(n) - n)[short], np.array(whole, np.uint64))
        n[short] = 1
    return out, n
