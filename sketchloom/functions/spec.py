"""Parameters of the summaries, checked on construction (ValueError)."""

from __future__ import annotations

import math
from dataclasses import dataclass


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def number(value, name: str, low=None, high=None, open_low: bool = False, open_high: bool = False):
    require(isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value), f"{name} must be a finite number")
    require(low is None or (value > low if open_low else value >= low), f"{name} is too small")
    require(high is None or (value < high if open_high else value <= high), f"{name} is too large")
    return value


@dataclass(frozen=True)
class HllSpec:
    p: int = 12

    def __post_init__(self):
        require(isinstance(self.p, int), "p must be an integer")
        number(self.p, "p", 4, 21)

    @property
    def m(self) -> int:
        return 1 << self.p


@dataclass(frozen=True)
class CpcSpec:
    lg_k: int = 11

    def __post_init__(self):
        require(isinstance(self.lg_k, int), "lg_k must be an integer")
        number(self.lg_k, "lg_k", 4, 26)

    @property
    def k(self) -> int:
        return 1 << self.lg_k


@dataclass(frozen=True)
class ThetaSpec:
    k: int = 4096

    def __post_init__(self):
        require(isinstance(self.k, int), "k must be an integer")
        number(self.k, "k", 1, 1 << 26)

    @property
    def nominal(self) -> int:
        """k rounded up to a power of two."""
        return 1 << (self.k - 1).bit_length()


@dataclass(frozen=True)
class LinearSpec:
    num_bits: int

    def __post_init__(self):
        require(isinstance(self.num_bits, int), "num_bits must be an integer")
        number(self.num_bits, "num_bits", 1)

    @property
    def m(self) -> int:
        return -(-self.num_bits // 64) * 64

    @classmethod
    def for_cardinality(cls, n: int, error: float) -> LinearSpec:
        number(n, "n", 1)
        number(error, "error", 0, 1, True, True)
        return cls(int(math.ceil(max(n / error**2, max(8 * n, 1024)))))


@dataclass(frozen=True)
class HybridSpec:
    linear: LinearSpec
    hll: HllSpec
    threshold: int

    @classmethod
    def for_range(cls, most: int) -> HybridSpec:
        number(most, "most", 1)
        bits = min(max(most // 10, 1024), 16384)
        return cls(LinearSpec(bits), HllSpec(10 if most < 10_000 else 12 if most < 1_000_000 else 14), bits // 10)


@dataclass(frozen=True)
class BloomSpec:
    capacity: int
    error: float = 0.01
    max_count: int = 255

    def __post_init__(self):
        number(self.capacity, "capacity", 1)
        number(self.error, "error", 0, 1, True, True)
        number(self.max_count, "max_count", 1, 255)

    @property
    def m(self) -> int:
        return math.ceil(-self.capacity * math.log(self.error) / math.log(2) ** 2)

    @property
    def k(self) -> int:
        return max(1, round(self.m / self.capacity * math.log(2)))


@dataclass(frozen=True)
class MatrixSpec:
    """Width and depth of a frequency table."""

    width: int
    depth: int

    def __post_init__(self):
        require(isinstance(self.width, int) and isinstance(self.depth, int), "width and depth must be integers")
        number(self.width, "width", 1)
        number(self.depth, "depth", 1, 64)

    @classmethod
    def for_error(cls, epsilon: float, delta: float) -> MatrixSpec:
        number(epsilon, "epsilon", 0, 1, True, True)
        number(delta, "delta", 0, 1, True, True)
        return cls(math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta)))


@dataclass(frozen=True)
class FrequentSpec:
    max_map_size: int

    def __post_init__(self):
        require(isinstance(self.max_map_size, int), "max_map_size must be an integer")
        number(self.max_map_size, "max_map_size", 1)

    @classmethod
    def for_error(cls, error: float, confidence: float = 0.95) -> FrequentSpec:
        number(error, "error", 0, 1, True, True)
        number(confidence, "confidence", 0, 1, True, True)
        return cls(math.ceil(3.5 / error))


@dataclass(frozen=True)
class KllSpec:
    k: int = 200

    def __post_init__(self):
        require(isinstance(self.k, int), "k must be an integer")
        number(self.k, "k", 8, 65535)

    @classmethod
    def for_error(cls, epsilon: float) -> KllSpec:
        """Rank error is about 1.65 % at k = 200 and falls as 1 / k."""
        number(epsilon, "epsilon", 0, 1, True, True)
        return cls(max(8, min(65535, math.ceil(200 * 0.0165 / epsilon))))


@dataclass(frozen=True)
class ReqSpec:
    k: int = 12
    mode: str = "HRA"

    def __post_init__(self):
        require(isinstance(self.k, int), "k must be an integer")
        number(self.k, "k", 4, 1024)
        require(self.mode in ("HRA", "LRA"), "mode must be HRA or LRA")


@dataclass(frozen=True)
class TDigestSpec:
    compression: float = 100.0

    def __post_init__(self):
        number(self.compression, "compression", 10, 10_000)

    @classmethod
    def for_error(cls, error: float) -> TDigestSpec:
        number(error, "error", 0, 1, True, True)
        return cls(min(max(1 / (4 * error), 50), 2000))


@dataclass(frozen=True)
class AodSpec:
    capacity: int = 4096
    num_values: int = 1

    def __post_init__(self):
        require(isinstance(self.capacity, int) and isinstance(self.num_values, int), "capacity and num_values must be integers")
        number(self.capacity, "capacity", 1)
        number(self.num_values, "num_values", 1)


@dataclass(frozen=True)
class SampleSpec:
    k: int

    def __post_init__(self):
        require(isinstance(self.k, int), "k must be an integer")
        number(self.k, "k", 1)
