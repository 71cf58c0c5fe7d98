"""A keyed shuffle of row numbers that needs no sort: a bijection that each row evaluates for itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """64 well mixed bits of x and key."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(key % 2**64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def bijection(numbers: np.ndarray, n: np.ndarray, key: int) -> np.ndarray:
    """Where each number from 0 to below n goes; for one n and key no two go to the same place.

    A Feistel network on a grid of about sqrt(n) by sqrt(n) cells: each round moves one coordinate by a hash of the other.
    The grid has at most sqrt(n) cells too many; what lands there goes on until it is inside.
    """
    n = np.broadcast_to(np.asarray(n, dtype=np.int64), numbers.shape)
    a = np.maximum(1, np.ceil(np.sqrt(n)).astype(np.int64))
    b = -(-n // a)
    out, todo = numbers.astype(np.int64).copy(), np.arange(len(numbers))
    while len(todo):
        x, y = np.divmod(out[todo], b[todo])
        for r in range(ROUNDS):
            if r % 2 == 0:
                x = (x + (_mixed(y, key * ROUNDS + r) % a[todo].astype(np.uint64)).astype(np.int64)) % a[todo]
            else:
                y = (y + (_mixed(x, key * ROUNDS + r) % b[todo].astype(np.uint64)).astype(np.int64)) % b[todo]
        out[todo] = x * b[todo] + y
        todo = todo[out[todo] >= n[todo]]
    return out


def shuffled(number: Column, n: Column | int, key: Column | int) -> Column:
    """The place, from 0, of a row number from 0 under the keyed bijection of n numbers.

    Each use in a query holds a Python process for each task; several keys in one column need only one.
    """

    @F.pandas_udf("long")
    def go(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for numbers, sizes, keys in parts:
            out = np.zeros(len(numbers), dtype=np.int64)
            for k in keys.unique():
                at = (keys == k).to_numpy()
                out[at] = bijection(numbers.to_numpy(np.int64)[at], sizes.to_numpy(np.int64)[at], int(k))
            yield pd.Series(out)

    long = lambda x: x if isinstance(x, Column) else F.lit(x).cast("long")
    return go(number, long(n), long(key))

