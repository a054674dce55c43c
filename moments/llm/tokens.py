"""Words of many texts at once, as hashes in numpy arrays; no Python loop over words.

A word is a run of bytes that are none of space, tab, line feed, vertical tab, form feed, carriage return; A-Z count as a-z.
Its hash is a polynomial of its bytes over the integers modulo 2^64, from differences of prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = (np.arange(1, 257, dtype="uint64") * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for k, b in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, b, "uint64")
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word of the bytes."""
    low = _LOWER[data]
    word = ~_SPACE[low]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view("int8")))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    run = np.zeros(len(data) + 1, "uint64")
    np.cumsum(_BYTE[low] * up[:-1], out=run[1:])
    return mix((run[end] - run[start]) * down[start]), start, end


def slices(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about size bytes: (number of the first, their bytes with a line feed after each, offsets)."""
    at = 0
    while at < len(texts):
        to, n = at, 0
        while to < len(texts) and (to == at or n + len(texts[to]) < size):
            n += len(texts[to]) + 1
            to += 1
        data = np.frombuffer(b"\n".join(texts[at:to]) + b"\n", dtype="uint8")
        ends = np.cumsum([len(x) + 1 for x in texts[at:to]])
        yield at, data, np.concatenate([[0], ends])
        at = to


def hashed_texts(texts: list[bytes], size: int = 1 << 20):
    """For each slice: (first text, word hashes, number of words by text, bytes, start, end of each word)."""
    for first, data, offsets in slices(texts, size):
        h, start, end = word_hashes(data)
        counts = np.diff(np.searchsorted(start, offsets))
        yield first, h, counts, data, start, end


def raw(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
