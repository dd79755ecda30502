"""Vectorised text kernels shared by the corpus operators.

Everything here runs inside Arrow batches on the executors and depends on numpy
only.  A batch of texts is turned into one flat array of word hashes plus
document offsets, so the per-document Python overhead stays constant no matter
how long the texts are.

Normalisation: texts are lower-cased and split at every character that is
neither a letter nor a digit.  ``None`` counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Characters handled at once; bounds the temporary arrays of a batch.
CHUNK_CHARS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element-wise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.full(255, _BASE)]).cumprod(dtype=np.uint64)


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts hold about ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def codepoints(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by one newline, and n + 1 offsets."""
    parts = [t or "" for t in texts]
    flat = np.frombuffer(("\n".join(parts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts)))
    return flat, np.concatenate([np.zeros(1, np.int64), ends])


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and n + 1 word offsets by text."""
    cp, ends = codepoints([(t or "").lower() for t in texts])
    word = _alnum()[cp]
    edge = np.diff(word.view(np.int8), prepend=np.int8(0))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    lengths = stops - starts
    letters = cp[word].astype(np.uint64)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, lengths)
    if lengths.max() > 256:  # words beyond 256 letters: powers are repeated, with a twist by block
        letters += (place >> 8).astype(np.uint64) << np.uint64(32)
        place &= 255
    letters += np.uint64(1)
    letters *= _powers()[place]
    sums = np.add.reduceat(letters, first)
    return mix64(sums ^ (lengths.astype(np.uint64) << np.uint64(56))), np.searchsorted(starts, ends)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of each text, in order, and their offsets.

    A text of 1 to n - 1 words has one shingle, made of all its words; a text
    without words has none.
    """
    counts = np.diff(offsets)
    total = len(words)
    if not total:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    acc = np.zeros(total, np.uint64)
    left = np.repeat(offsets[1:], counts) - np.arange(total)  # words up to the end of the text
    with np.errstate(over="ignore"):
        for k in range(n):
            part = padded[k : k + total] * _powers()[k + 1]
            acc += np.where(left > k, part, np.uint64(0)) if k else part
    keep = (left >= n) | ((left == np.repeat(counts, counts)) & (left < n))
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    return mix64(acc[keep]), np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])


@lru_cache(maxsize=8)
def minhash_multipliers(k: int, seed: int = 7) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, 2**63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhash_rows(values: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """A (k, len(values)) array of 32-bit hashes by k multiply-shift functions."""
    a = minhash_multipliers(k, seed)
    with np.errstate(over="ignore"):
        return ((values[None, :] * a[:, None]) >> np.uint64(32)).astype(np.uint32)


def minhash(values: np.ndarray, offsets: np.ndarray, k: int, seed: int = 7, block: int = 4096) -> np.ndarray:
    """MinHash signatures, shape (texts, k), uint32; texts without values get all ones."""
    n = len(offsets) - 1
    out = np.full((n, k), np.uint32(0xFFFFFFFF))
    a = minhash_multipliers(k, seed)
    with np.errstate(over="ignore"):
        for i in range(n):
            for lo in range(int(offsets[i]), int(offsets[i + 1]), block):
                v = values[lo : min(lo + block, int(offsets[i + 1]))]
                low = (v[None, :] * a[:, None]).min(axis=1) >> np.uint64(32)
                np.minimum(out[i], low.astype(np.uint32), out=out[i])
    return out
