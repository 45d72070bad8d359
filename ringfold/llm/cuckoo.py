"""A cuckoo filter of 64-bit hashes as plain bytes: add, take away, ask.

A hash has a 16-bit fingerprint and two buckets of four cells; each bucket
follows from the other and the fingerprint. Hashes that find no cell within
``KICKS`` moves are kept whole beside the filter, so nothing is ever refused and
what was added is always found. Only what was added may be taken away.
"""

from __future__ import annotations

import numpy as np

CELLS = 4
KICKS = 500
# Largest share of cells in use before a filter is built anew.
LOAD = 0.9
SPREAD = 0x5BD1E995


def buckets_for(items: int) -> int:
    """Buckets, a power of two, for so many items with room to grow."""
    return 1 << max(0, (int(items * 1.25 / (CELLS * LOAD)) or 1) - 1).bit_length()


def fits(items: int, buckets: int) -> bool:
    return items <= LOAD * CELLS * buckets


def _print(h: int) -> int:
    return (h & 0xFFFF) or 1


def _other(bucket: int, mark: int, buckets: int) -> int:
    return (bucket ^ (mark * SPREAD)) & (buckets - 1)


class CuckooFilter:
    def __init__(self, buckets: int, cells: bytes | None = None, extra: list[int] | None = None) -> None:
        self.buckets = buckets
        self.cells = (
            [0] * (buckets * CELLS) if cells is None else np.frombuffer(cells, "<u2").tolist()
        )
        self.extra = [] if extra is None else [int(h) for h in extra]

    def to_bytes(self) -> bytes:
        return np.array(self.cells, "<u2").tobytes()

    def _places(self, h: int) -> tuple[int, int, int]:
        mark, first = _print(h), (h >> 16) & (self.buckets - 1)
        return mark, first, _other(first, mark, self.buckets)

    def _put(self, bucket: int, mark: int) -> bool:
        for c in range(bucket * CELLS, (bucket + 1) * CELLS):
            if not self.cells[c]:
                self.cells[c] = mark
                return True
        return False

    def add(self, h: int) -> None:
        """``h`` is a signed 64-bit hash that was not added before."""
        mark, first, second = self._places(h)
        if self._put(first, mark) or self._put(second, mark):
            return
        moved, bucket = [], second
        for kick in range(KICKS):
            c = bucket * CELLS + (kick + mark) % CELLS
            moved.append((c, self.cells[c]))
            self.cells[c], mark = mark, self.cells[c]
            bucket = _other(bucket, mark, self.buckets)
            if self._put(bucket, mark):
                return
        for c, old in reversed(moved):  # as before, with this hash kept whole
            self.cells[c] = old
        self.extra.append(h)

    def remove(self, h: int) -> None:
        """Take away a hash that was added."""
        if h in self.extra:
            self.extra.remove(h)
            return
        mark, first, second = self._places(h)
        for bucket in (first, second):
            for c in range(bucket * CELLS, (bucket + 1) * CELLS):
                if self.cells[c] == mark:
                    self.cells[c] = 0
                    return
        raise KeyError(h)


def asked(cells: np.ndarray, buckets: int, extra: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For many hashes at once whether a filter may hold them."""
    mark = hashes & 0xFFFF
    mark[mark == 0] = 1
    first = (hashes >> 16) & (buckets - 1)
    second = (first ^ (mark * SPREAD)) & (buckets - 1)
    table = cells.reshape(buckets, CELLS)
    hit = (table[first] == mark[:, None]).any(axis=1) | (table[second] == mark[:, None]).any(axis=1)
    return hit | np.isin(hashes, extra) if len(extra) else hit
