"""Words, and 64-bit hashes of words, of a column of texts, without a Python loop over words.

A word is a run of bytes other than tab, line feed, vertical tab, form feed, carriage return and space; no byte of a
longer UTF-8 sequence is one of these, so the words are those of the code points. Texts are taken whole, in groups of
about ``CHUNK`` bytes (a longer text is a group by itself), so that memory is a small multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A word's weight by its place in a run: random, so that different orders of a few words differ, and odd.
_FACTORS = np.random.default_rng(20240608).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


@dataclass
class Group:
    """Some texts of a column: ``first`` is the row of the first; ``bounds`` the texts' byte bounds in ``data``.

    ``start``/``end``/``text``/``hash`` have an entry for each word; ``words`` are the bounds of the texts' words.
    """

    first: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def _group(first: int, data: np.ndarray, bounds: np.ndarray, lower: bool) -> Group:
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start])
    text = np.searchsorted(bounds, start, "right") - 1
    return Group(first, data, bounds, start, end, text, hashes, np.searchsorted(start, bounds))


def groups(column: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[Group]:
    """The texts of a string column in groups; a null counts as an empty text. ``lower``: hash A-Z as a-z."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.cast(pa.large_string()).fill_null("")
        if not len(part):
            continue
        bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2] or b"", np.uint8)
        k = 0
        while k < len(part):
            stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + CHUNK, "right")) - 1)
            yield _group(k, data[bounds[k] : bounds[stop]], bounds[k : stop + 1] - bounds[k], lower)
            k = stop


def windows(group: Group, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within a text, and the bounds of each text's runs."""
    n = np.maximum(np.diff(group.words) - size + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(n)))
    every = len(group.hash) - size + 1
    if every <= 0:
        return np.empty(0, np.uint64), bounds
    out = np.zeros(every, np.uint64)
    for j in range(size):
        out += group.hash[j : j + every] * _FACTORS[j]
    return mix(out[group.text[:every] == group.text[size - 1 :]]), bounds


def shingle_sets(group: Group, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one text's after another's, and the texts' bounds in them; the whole sequence where a text has fewer than ``size`` words."""
    runs, bounds = windows(group, size)
    words = np.diff(group.words)
    short = (words > 0) & (words < size)
    few = np.flatnonzero(short)
    # A text of few words has one shingle: its place is made before the next text's runs.
    whole = [np.sum(group.hash[a : a + n] * _FACTORS[:n], dtype=np.uint64) + np.uint64(n) for a, n in zip(group.words[few], words[few], strict=True)]
    values = np.insert(runs, bounds[few], mix(np.array(whole, np.uint64)))
    bounds = np.concatenate(([0], np.cumsum(np.diff(bounds) + short)))
    for a, b in pairwise(bounds.tolist()):
        values[a:b].sort()
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    first[bounds[:-1][bounds[:-1] < len(values)]] = True
    return values[first], np.concatenate(([0], np.cumsum(first)))[bounds]
