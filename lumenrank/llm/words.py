"""Hashes of the words of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are hashed in runs of about so many bytes (a longer text makes a run of its own).
RUN_BYTES = 500_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_PLAIN = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_powers: list[np.ndarray] = [np.ones(1, dtype=_U), np.ones(1, dtype=_U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n, modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, RUN_BYTES) + 1, base, dtype=_U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=_U)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, where each row begins and ends in them); null texts are empty."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1)
        last = min(last, len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, in order, and how many words lie before each row (one more entry than rows).

    Words are runs of bytes other than ASCII white space; rows do not join. lower: A-Z as a-z.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=_U), np.zeros(len(bounds), dtype=np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | np.concatenate((~inside[1:], [True])))) + 1
    up, down = _power(n)
    sums = np.concatenate((np.zeros(1, dtype=_U), np.cumsum((_LOWER if lower else _PLAIN)[data] * up[:n], dtype=_U)))
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, bounds)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words of the array (one for each start that has n words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=_U)
    total = np.zeros(m, dtype=_U)
    for k in range(n):
        total = total * _U(_BASE) + words[k : k + m]
    return mix(total)
