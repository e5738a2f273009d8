"""Words of a batch of texts as 64-bit hashes, array by array."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Separators as byte sets: blanks, and all ASCII but 0-9 and a-z.
BLANKS = bytes([9, 10, 11, 12, 13, 32])
NO_WORD = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    p = np.full(n, 0x5851F42D4C957F2D, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_hashes(texts: list[str], separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words with A-Z lower-cased, text after text, and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    word = inside[flat]
    first = word.copy()
    first[1:] &= ~word[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = flat[word]
    before = np.cumsum(word) - word  # letters before each byte
    begin = before[starts]
    lengths = np.diff(begin, append=len(letters))
    place = np.arange(len(letters)) - np.repeat(begin, lengths)
    powers = _powers(1 << max(10, int(lengths.max()).bit_length()))
    return mix(np.add.reduceat(_letters()[letters] * powers[place], begin)), counts


def batches_of(texts, most: int = 1 << 21):
    """Index ranges of consecutive texts that hold about ``most`` characters together."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i - at >= 255:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
