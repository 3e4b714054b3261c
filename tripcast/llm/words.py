"""Hashes of a text's words and five-word shingles, vectorised over many texts.

Words are runs of other bytes than ASCII white space, A-Z in lower case. A
word's hash is the sum of one random 64-bit number for each (place, byte),
mixed with its length.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
BLOCK = 1 << 19  # bytes hashed at a time

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLACES = 64
_RANDOM = np.random.default_rng(7).integers(0, 1 << 64, _PLACES << 8, np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _block_hashes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a block of bytes."""
    inside = ~_SPACE[block]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    value = _RANDOM[((place & (_PLACES - 1)) << 8) | block[inside]]
    if lengths.max() > _PLACES:
        far = place >= _PLACES
        value[far] = mix(value[far] + (place[far] // _PLACES).astype(np.uint64) * _M1)
    return starts, mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _M1)


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of all texts in a row, and the number of words of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    starts, hashes, lo = [], [], 0
    while lo < len(data):
        hi = min(lo + BLOCK, len(data))
        if hi < len(data):  # no word is cut
            back = np.flatnonzero(_SPACE[data[lo:hi]][::-1])
            hi = hi - int(back[0]) if len(back) else hi + int(np.argmax(_SPACE[data[hi:]])) + 1
        s, h = _block_hashes(data[lo:hi])
        starts.append(s + lo)
        hashes.append(h)
        lo = hi
    starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def chain(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring words."""
    rows = max(len(h) - size + 1, 0)
    s = np.full(rows, size, np.uint64)
    for k in range(size):
        s = mix(s * _M1 + h[k:k + rows])
    return s


def shingle_sets(texts: list) -> list[np.ndarray]:
    """For each text its sorted distinct five-word shingles; a shorter text is one shingle."""
    words, counts = word_hashes(texts)
    runs = chain(words, SHINGLE)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(runs[at:at + n - SHINGLE + 1]))
        else:
            out.append(chain(words[at:at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out
