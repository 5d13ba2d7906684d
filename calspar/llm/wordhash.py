"""Words of UTF-8 texts and hashes of runs of words, as numpy arrays over many texts at a time."""

from __future__ import annotations

import numpy as np

_seeded = np.random.default_rng(20240607)
#: A 64-bit value for each byte, and odd multipliers.
BYTE_VALUES = _seeded.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IN_WORD, FIRST, SECOND = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def inverse(m: np.uint64) -> np.uint64:
    return np.uint64(pow(int(m), -1, 1 << 64))


class Words:
    """Words (runs of bytes other than ASCII white space) of several texts.

    hash: of each word; text k has words bounds[k] to bounds[k + 1].
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            data = LOWER[data]
        space = SPACES[data]
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(starts, offsets)
        self.n = len(starts)
        if not self.n:
            self.hash = np.zeros(0, np.uint64)
            return
        lengths = np.diff(np.append(starts, len(data)))
        place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), IN_WORD))
        values = np.where(space[starts[0] :], np.uint64(0), BYTE_VALUES[data[starts[0] :]] * powers[place])
        self.hash = mixed(np.add.reduceat(values, starts - starts[0]))

    def left(self) -> np.ndarray:
        """For each word, how many words of its text there are from it on."""
        counts = np.diff(self.bounds)
        return np.repeat(self.bounds[1:], counts) - np.arange(self.n)


class Runs:
    """Hashes of runs of words by prefix sums: run [a, b) has the same hash wherever it stands."""

    def __init__(self, words: Words, multiplier: np.uint64 = FIRST):
        n = words.n
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse(multiplier))]))
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), multiplier)]))[:n]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hash * powers, dtype=np.uint64)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
