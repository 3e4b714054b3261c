"""Token ids of whole texts from the ids of their distinct chunks.

A chunk is a run of white space and the run of other characters after it (or
the latter alone). No token of the tokenizers used here crosses from the end of
a chunk into the next, so the ids of a text are its chunks' ids in a row. Each
worker keeps the ids of up to ``LIMIT`` chunks met so far.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np

LIMIT = 300_000
SEGMENT = 1 << 19  # characters handled at a time

#: Unicode's White_Space, as the tokenizers' patterns read it. Fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WITH_SPACE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BLANKS = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
WITHOUT_SPACE = re.compile(f"[^{SPACE}]+")
_CUT = re.compile(f"(?<=[^{SPACE}])(?=[{SPACE}])")


def segments(text: str):
    """The text in parts of about SEGMENT characters, cut only where a chunk ends."""
    lo = 0
    while len(text) - lo > SEGMENT:
        m = _CUT.search(text, lo + SEGMENT)
        if not m:
            break
        yield text[lo:m.start()]
        lo = m.start()
    yield text[lo:] if lo else text


def spread(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches (start, length) of ``flat`` in a row."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - ends + length, length)]


class Remembered:
    """Ids of strings met so far. ``encode`` maps a list of strings to their ids
    in a row and the number of ids of each. Beyond ``limit`` strings, those that
    were asked for only once since the last time are forgotten."""

    def __init__(self, encode, limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self._hold([], np.empty(0, np.uint32), np.empty(0, np.int64))

    def _hold(self, keys: list, flat: np.ndarray, length: np.ndarray):
        self.index = dict(zip(keys, range(len(keys))))
        self.flat, self.length = flat, length
        self.start, self.asked = np.cumsum(length) - length, np.zeros(len(keys), np.int32)

    def _forget(self):
        stay = self.asked > 1
        if stay.sum() > self.limit // 2:
            stay[:] = False
        keys = [k for k, s in zip(self.index, stay.tolist()) if s]
        self._hold(keys, spread(self.flat, self.start[stay], self.length[stay]), self.length[stay])

    def _find(self, strings: list) -> tuple[np.ndarray, list, dict]:
        """The place of each string (-1: not known), where the unknown ones stand, and these once each."""
        at = np.fromiter(map(self.index.get, strings, repeat(-1)), np.int64, len(strings))
        miss = np.flatnonzero(at < 0).tolist()
        return at, miss, dict.fromkeys([strings[i] for i in miss])

    def lookup(self, strings: list) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings in a row, and the number of ids of each."""
        at, miss, new = self._find(strings)
        if new and len(self.index) + len(new) > self.limit:
            self._forget()
            at, miss, new = self._find(strings)
        if new:
            flat, length = self.encode(list(new))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            at[miss] = [self.index[strings[i]] for i in miss]
            self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
            self.length = np.concatenate((self.length, length))
            self.flat = np.concatenate((self.flat, flat))
            self.asked = np.concatenate((self.asked, np.zeros(len(new), np.int32)))
        self.asked += np.bincount(at, minlength=len(self.asked)).astype(np.int32)
        length = self.length[at]
        return spread(self.flat, self.start[at], length), length


class TextIds:
    """The ids of whole texts, by way of their chunks."""

    def __init__(self, pattern: re.Pattern, encode, limit: int = LIMIT):
        self.chunks_of, self.known = pattern.findall, Remembered(encode, limit)

    def _some(self, texts: list[str]) -> list[np.ndarray]:
        chunks, count = [], [0]
        for t in texts:
            chunks += self.chunks_of(t)
            count.append(len(chunks))
        ids, length = self.known.lookup(chunks)
        cuts = np.concatenate(([0], np.cumsum(length)))[count]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def ids(self, texts: list):
        """The ids of each text in turn (null: none), in bounded parts."""
        group, size = [], 0
        for t in texts:
            t = t or ""
            if size and size + len(t) > SEGMENT:
                yield from self._some(group)
                group, size = [], 0
            if len(t) > SEGMENT:
                yield np.concatenate([self._some([s])[0] for s in segments(t)])
                continue
            group.append(t)
            size += len(t) + 1
        yield from self._some(group)
