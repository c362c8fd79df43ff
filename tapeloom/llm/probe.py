"""Tables of hash bits for Python workers: of bounded size, made by a distributed aggregate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest table has 2 to this power bits (8 MB). A fuller one lets more through, and the join that follows stays exact.
MOST_BITS = 26


@dataclass(frozen=True)
class BitTable:
    """Two bits for each listed hash, by the leading bits of its upper and of its lower half."""

    words: np.ndarray
    bits: int

    def _set(self, cell: np.ndarray) -> np.ndarray:
        return (self.words[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63))) & np.uint64(1) == 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where the hashes are that may be listed; of the others about one in a thousand is too, while the table is within its bound."""
        at = np.flatnonzero(self._set(hashes >> np.uint64(64 - self.bits)))
        return at[self._set((hashes[at] << np.uint64(32)) >> np.uint64(64 - self.bits))]


def bit_table(hashes: DataFrame, column: str, n: int) -> BitTable:
    """The table of a long column with about n values, 64 bits a value where the bound allows."""
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) * 64)), 12, MOST_BITS))
    both = F.array(F.shiftrightunsigned(column, 64 - bits), F.shiftrightunsigned(F.shiftleft(column, 32), 64 - bits))
    cells = hashes.select(F.explode(both).alias("c"))
    packed = cells.groupBy(F.shiftrightunsigned("c", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(c & 63))")).alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[packed.column("w").to_numpy()] = packed.column("b").to_numpy().view(np.uint64)
    return BitTable(words, bits)


class Tally:
    """Sums by hash over a task's rows: what is told grows with the different hashes, not with the rows. Beyond a bound it is told in parts."""

    def __init__(self, most: int = 1 << 17):
        self.most, self.keys, self.sums, self.size = most, [], [], 0

    def add(self, hashes: np.ndarray, weights: np.ndarray) -> None:
        self.keys.append(hashes)
        self.sums.append(weights)
        self.size += len(hashes)
        if self.size > 2 * self.most:
            self._merge()

    def _merge(self) -> None:
        keys, at = np.unique(np.concatenate(self.keys) if self.keys else np.empty(0, np.uint64), return_inverse=True)
        # bincount of nothing gives whole numbers, whatever its weights; every batch of a task must have the same types
        self.sums = [np.bincount(at, np.concatenate(self.sums) if self.sums else np.empty(0), len(keys)).astype(np.float64, copy=False)]
        self.keys, self.size = [keys], len(keys)

    @property
    def full(self) -> bool:
        return self.size > self.most and len(self.keys) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, sums) so far; then it is empty."""
        self._merge()
        out = self.keys[0], self.sums[0]
        self.keys, self.sums, self.size = [], [], 0
        return out
