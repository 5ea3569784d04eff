"""64-bit hashes of words and word shingles, vectorised over the bytes of many texts.

A word's hash is a polynomial over random 64-bit values of its bytes, then mixed; a shingle's combines those of its
words. Equal texts have equal hashes everywhere; different ones collide with a chance of about 2**-64 per pair.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x9, 0xE)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    letters = np.flatnonzero(~space)
    first = np.flatnonzero(np.isin(letters, starts, assume_unique=True))
    length = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, length)
    power = np.cumprod(np.full(int(length.max()), _BASE, np.uint64))
    return mix(np.add.reduceat(_BYTE[data[letters]] * power[place], first)), counts


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, ASCII letters lower-cased; one for the whole of a shorter text."""
    hashes, counts = word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])
    rolled = np.zeros(max(len(hashes) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = mix(rolled + np.uint64(k + 1)) + hashes[k : k + len(rolled)]
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            h = np.uint64([n])
            for w in hashes[at : at + n]:
                h = mix(mix(h) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
