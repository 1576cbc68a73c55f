"""Word shingles of a text as numbers, by array operations over its bytes."""

from __future__ import annotations

import numpy as np

from .common import mix64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0xD1B54A32D192ED03
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; powers are kept for so many.
CHUNK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)


def words_at(data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of a byte array, in order, and where it begins; ``fold`` lowers A-Z."""
    out, places = [], []
    at, part = 0, None  # part: hash, length and place of a word that goes on in the next piece
    while at < len(data):
        end = min(len(data), at + CHUNK)
        piece = data[at:end]
        cut = end < len(data)
        if cut:  # at white space; a word longer than a chunk is carried over the border
            spaces = np.flatnonzero(_SPACE[piece])
            if len(spaces):
                end, cut = at + int(spaces[-1]) + 1, False
                piece = data[at:end]
        gap = _SPACE[piece]
        edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
        begin, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        low = (_LOWER[piece] if fold else piece).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * _DOWN[: len(piece)], dtype=np.uint64)])
        h, n, place = (total[stop] - total[begin]) * _UP[stop], stop - begin, begin + at
        if part:
            if gap[0]:
                h, n, place = (np.concatenate([np.array([x], y.dtype), y]) for x, y in zip(part, (h, n, place), strict=True))
            else:
                h[0] = np.uint64((int(h[0]) + int(part[0]) * pow(_BASE, int(n[0]), 1 << 64)) % (1 << 64))
                n[0] += part[1]
                place[0] = part[2]
            part = None
        if cut:
            part = h[-1], n[-1], place[-1]
            h, n, place = h[:-1], n[:-1], place[:-1]
        out.append(mix64(h + n.astype(np.uint64)))
        places.append(place)
        at = end
    return (np.concatenate(out), np.concatenate(places)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hashes of the words of a byte array, A-Z lowered, in order."""
    return words_at(data)[0]


def shingle_set(data: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than ``size`` make one shingle of all."""
    w = word_hashes(data)
    if not len(w):
        return w
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        h = mix64(h * np.uint64(_BASE) + w[k : k + n])
    return np.unique(h)
