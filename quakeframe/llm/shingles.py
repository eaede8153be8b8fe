"""Word shingles by numpy over many texts at once."""

from __future__ import annotations

import numpy as np

from quakeframe.llm.common import chunks, pack

#: Base of the polynomial word hash, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _blank_table() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[32, *range(9, 14)]] = True
    return table


LOWERED, BLANK = _lower_table(), _blank_table()


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = np.zeros(0, dtype=np.uint64)
    down = np.zeros(0, dtype=np.uint64)

    @classmethod
    def of(cls, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= size:
            cls.up, cls.down = _powers(BASE, size), _powers(INVERSE, size)
        return cls.up[: size + 1], cls.down[: size + 1]


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the A-Z lower-cased words of all texts in order, and the number of words of each text."""
    buffer, starts, ends = pack(texts)
    blank = BLANK[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    first, last = edge[::2], edge[1::2]
    up, down = _Powers.of(len(buffer))
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum((LOWERED[buffer].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    words = scramble((sums[last] - sums[first]) * down[first])
    return words, np.searchsorted(first, ends) - np.searchsorted(first, starts)


def shingle_sets(texts: list[bytes], width: int = 5, limit: int = 1 << 20):
    """The sorted distinct shingle hashes of each text; shorter texts have one for all their words, or none."""
    factors = _powers(0xD6E8FEB86659FD93, width)[1:]
    for start, end in chunks(texts, limit):
        words, counts = word_hashes(texts[start:end])
        size = max(len(words) - width + 1, 0)
        rolled = np.zeros(size, dtype=np.uint64)
        for i in range(width):
            rolled += words[i : i + size] * factors[i]
        rolled = scramble(rolled)
        at = 0
        for n in counts:
            if n >= width:
                yield np.unique(rolled[at : at + n - width + 1])
            elif n:
                yield scramble((words[at : at + n] * factors[:n]).sum(keepdims=True) + np.uint64(n))
            else:
                yield np.zeros(0, dtype=np.uint64)
            at += n
