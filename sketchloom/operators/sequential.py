"""Order-dependent estimators for a single stream: historic inverse probability (HIP) for HLL and CPC, and conservative Count-Min.

They need every item in order, so they are offered per task or for a stream in one process, never after a shuffle; merged states use the
estimators of ``cardinality``. Items are bytes, hashed by xxh3 with seed 9001.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

from ..functions.spec import CpcSpec, HllSpec, MatrixSpec
from .frequency import conservative_update

SEED = 9001


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Of 64-bit values."""
    high, low = (x >> np.uint64(32)).astype(np.float64), (x & np.uint64(2**32 - 1)).astype(np.float64)
    of = lambda v: 32 - np.where(v > 0, np.floor(np.log2(np.maximum(v, 1))) + 1, 0).astype(np.int64)  # noqa: E731  exact under 2^32
    return np.where(high > 0, of(high), 32 + of(low))


class HipHll:
    def __init__(self, spec: HllSpec = HllSpec()):
        self.spec, self.registers, self.hip, self.open = spec, np.zeros(spec.m, dtype=np.int64), 0.0, float(spec.m)

    def update(self, items: Iterable[bytes]) -> HipHll:
        h = np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in items), dtype=np.uint64)
        index = (h >> np.uint64(64 - self.spec.p)).astype(np.int64)
        rank = np.minimum(leading_zeros(h << np.uint64(self.spec.p)) + 1, 64)
        for i, r in zip(index[keep := rank > self.registers[index]].tolist(), rank[keep].tolist(), strict=True):
            old = int(self.registers[i])
            if r > old:
                self.hip += self.spec.m / self.open
                self.open += 2.0**-r - 2.0**-old
                self.registers[i] = r
        return self

    def estimate(self) -> float:
        return self.hip


class HipCpc:
    def __init__(self, spec: CpcSpec = CpcSpec()):
        self.spec, self.coupons, self.hip, self.open = spec, set(), 0.0, float(spec.k)

    def update(self, items: Iterable[bytes]) -> HipCpc:
        for x in items:
            h = xxhash.xxh3_128_intdigest(x, SEED)
            row, col = h & (self.spec.k - 1), min(64 - (h >> 64).bit_length(), 63)
            if (row, col) not in self.coupons:
                self.coupons.add((row, col))
                self.hip += self.spec.k / self.open
                self.open -= 2.0 ** -(col + 1)
        return self

    def estimate(self) -> float:
        return self.hip


class ConservativeCountMin:
    """Count-Min whose cells are raised no further than needed; never under the true count."""

    def __init__(self, spec: MatrixSpec):
        self.spec, self.cells = spec, np.zeros((spec.depth, spec.width), dtype=np.int64)

    def _columns(self, item: bytes) -> list[int]:
        return [xxhash.xxh3_64_intdigest(item, SEED + r) % self.spec.width for r in range(self.spec.depth)]

    def update(self, item: bytes, count: int = 1) -> None:
        at = self._columns(item)
        fresh = conservative_update([int(self.cells[r, c]) for r, c in enumerate(at)], count)
        for (r, c), n in zip(enumerate(at), fresh, strict=True):
            self.cells[r, c] = n

    def estimate(self, item: bytes) -> int:
        return min(int(self.cells[r, c]) for r, c in enumerate(self._columns(item)))
