"""Words as 64-bit hashes.

Words are runs of bytes other than the six ASCII white-space characters, with A-Z
lowered; ``bytes.lower().split()`` does exactly that. A word's hash is kept per
worker, so a repeated word costs one look-up.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words remembered by a worker before it starts anew.
REMEMBERED = 400_000

# Odd multipliers, one a place: equal words at other places give another sum.
_PLACES = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) ^ (0xD6E8FEB86659FD93 * (k + 1))) & 0xFFFFFFFFFFFFFFFF | 1) for k in range(16)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_known = _Hashes()


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashed(words: list[bytes]) -> np.ndarray:
    if len(_known) > REMEMBERED:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def placed(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """The hashes times each of the first ``n`` multipliers, from which :func:`summed` builds masks."""
    return [hashes * c for c in _PLACES[:n]]


def summed(products: list[np.ndarray], offsets: tuple[int, ...], n: int) -> np.ndarray:
    """For each of ``n`` starts the hash of the words at ``start + offset`` for all offsets, in order.

    Word hashes are uniform, so the sum of products is as well.
    """
    out = products[0][offsets[0]:offsets[0] + n].copy()
    for p, o in zip(products[1:], offsets[1:]):
        out += p[o:o + n]
    return out


def joined(hashes: np.ndarray, offsets: tuple[int, ...], n: int) -> np.ndarray:
    return summed(placed(hashes, len(offsets)), offsets, n)


def shingles(words: list[bytes], width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; of fewer words, of the whole run."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashed(words)
    if len(words) < width:
        return joined(h, tuple(range(len(words))), 1)
    out = joined(h, tuple(range(width)), len(words) - width + 1)
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]
