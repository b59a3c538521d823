"""Word and shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

from .common import ASCII_LOWER

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multiplier of the word polynomial, and those of the words of a shingle by position.
BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lowered, split at ASCII white space) of all texts, and how many words each text has."""
    x = np.frombuffer(b" ".join(texts).translate(ASCII_LOWER) + b" ", np.uint8)
    space = SPACE[x]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.append(0, edge)
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U), np.zeros(len(texts), np.int64)
    length = ends - starts
    kept = x[~space]
    first = np.cumsum(length) - length
    within = np.arange(len(kept)) - np.repeat(first, length)
    own = (kept.astype(U) + U(1)) * powers(int(length.max()))[within]
    hashes = mix(np.add.reduceat(own, first) + length.astype(U) * U(0xD6E8FEB86659FD93))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than width, one for the whole sequence."""
    hashes, counts = words(texts)
    turn = [mix(np.array([j + 1], U))[0] | U(1) for j in range(width)]
    out, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        if n >= width:
            total = np.zeros(n - width + 1, U)
            for j in range(width):
                total += own[j : n - width + 1 + j] * turn[j]
            out.append(np.unique(mix(total)))
        elif n:
            out.append(mix(np.array([(own * np.array(turn[:n], U)).sum() + U(n)], U)))
        else:
            out.append(np.empty(0, U))
    return out
