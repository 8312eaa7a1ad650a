"""Hashed sets of five-word shingles of many texts at once.

Words are runs of other characters than ASCII white space, A to Z in lower case. A text of one to four
words has one shingle, the whole of it; a text without words has none. Hashes are of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
ODD = np.random.default_rng(5).integers(1, 1 << 63, WIDTH + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each text (and in all)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer((b"\n" + b"\n".join(parts) + b"\n").translate(TABLE), np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    begins = np.concatenate([[1], np.cumsum([len(p) + 1 for p in parts]) + 1]) if parts else np.array([1])
    edges = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), edges
    gaps = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, gaps)
    powers = np.ones(int(gaps.max()), np.uint64)
    powers[1:] = ODD[WIDTH]
    powers = np.cumprod(powers, dtype=np.uint64)
    value = np.where(space[starts[0] :], 0, data[starts[0] :].astype(np.uint64) + np.uint64(1)) * powers[place]
    return mixed(np.add.reduceat(value, starts - starts[0])), edges


def shingle_sets(texts: list[str], also: tuple[int, ...] = ()) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    With ``also``, widths below five, a text's runs of so many words are in its set too, each
    with the hash that a text of just these words has.
    """
    words, edges = word_hashes(texts)
    n = max(0, len(words) - WIDTH + 1)
    every = np.full(n, ODD[WIDTH + 1], np.uint64)
    for j in range(WIDTH):
        every += words[j : n + j] * ODD[j]
    every = mixed(every)
    runs = {width: short_runs(words, width) for width in also}
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if last - first >= WIDTH:
            own = every[first : last - WIDTH + 1]
        elif last > first:
            own = short_runs(words[first:last], last - first)
        else:
            own = words[:0]
        if runs and last > first:
            own = np.concatenate([own, *(of[first : last - width + 1] for width, of in runs.items() if width <= last - first)])
        yield np.unique(own)


def short_runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, fewer than five."""
    n = max(0, len(words) - width + 1)
    total = np.full(n, width, np.uint64)
    for j in range(width):
        total += words[j : n + j] * ODD[j]
    return mixed(total)
