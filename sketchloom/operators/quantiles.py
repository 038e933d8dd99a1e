"""Quantiles: Spark's KLL aggregate, and relative-error (REQ) and t-digest summaries as Arrow aggregates.

Building REQ and t-digest states: each task folds its rows into one bounded state per key as Arrow batches stream by (a map-side combine), the
states are shuffled by key and merged in groups of bounded size. States are bytes and can be stored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spec import KllSpec, ReqSpec, TDigestSpec, require
from ..sources.codec import pack, unpack

# -- KLL ------------------------------------------------------------------------------------------------------------------


def kll_build(df: DataFrame, value: str, keys: list[str], spec: KllSpec = KllSpec()) -> DataFrame:
    """keys.., sketch, n, min, max; NaN and null are left out."""
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(
        F.kll_sketch_agg_double(v, F.lit(spec.k)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(v).alias("min"), F.max(v).alias("max")
    )


def kll_merge(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"))


def kll_quantiles(states: DataFrame, ranks: list[float], keys: list[str]) -> DataFrame:
    """keys.., q0, q1, ..: rank 0 is the minimum, rank 1 the maximum."""
    for r in ranks:
        require(0 <= r <= 1, "a rank lies between 0 and 1")
    pick = lambda r: F.col("min") if r == 0 else F.col("max") if r == 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(r)))
    return states.select(*keys, *[pick(r).alias(f"q{i}") for i, r in enumerate(ranks)])


def kll_statistics(states: DataFrame, keys: list[str], spec: KllSpec = KllSpec()) -> DataFrame:
    """keys.., k, total_count, min, max, min_value_set, max_value_set, memory_usage (bytes of the state)."""
    return states.select(
        *keys, F.lit(spec.k).cast("bigint").alias("k"), F.kll_sketch_get_n_double("sketch").alias("total_count"), "min", "max",
        F.col("min").isNotNull().alias("min_value_set"), F.col("max").isNotNull().alias("max_value_set"), F.length("sketch").cast("bigint").alias("memory_usage"),
    )


def kll_ranks(states: DataFrame, splits: list[float], keys: list[str]) -> DataFrame:
    """keys.., cdf: array of inclusive ranks of the split points and a last 1; pmf: its differences."""
    require(list(splits) == sorted(set(splits)), "split points ascend")
    ranks = [F.kll_sketch_get_rank_double("sketch", F.lit(float(s))) for s in splits]
    cdf = [*ranks, F.lit(1.0)]
    pmf = [cdf[0]] + [b - a for a, b in zip(cdf, cdf[1:], strict=False)]
    return states.select(*keys, F.array(*cdf).alias("cdf"), F.array(*pmf).alias("pmf"))


# -- REQ ------------------------------------------------------------------------------------------------------------------


class Req:
    """Relative-error quantiles: levels of weight 2^h, halved with the accurate end (high for HRA, low for LRA) left alone. The choice of odd or even
    alternates, so states are deterministic."""

    def __init__(self, spec: ReqSpec):
        self.spec, self.n, self.min, self.max = spec, 0, math.inf, -math.inf
        self.levels: list[np.ndarray] = [np.zeros(0)]
        self.turn = 0

    def capacity(self, level: int) -> int:
        return max(16 * self.spec.k, 2 * self.spec.k * max(1, math.ceil(math.log2(max(2, self.n / max(1, self.spec.k)))) - level))

    def add(self, values: np.ndarray) -> Req:
        values = values[~np.isnan(values)]
        if len(values):
            self.n += len(values)
            self.min, self.max = min(self.min, float(values.min())), max(self.max, float(values.max()))
            self.levels[0] = np.concatenate([self.levels[0], values])
            self.compact()
        return self

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            items = self.levels[level]
            if len(items) > self.capacity(level):
                items = np.sort(items)
                guard = self.capacity(level) // 2
                m = len(items) - guard
                m -= m % 2
                free, kept = (items[:m], items[m:]) if self.spec.mode == "HRA" else (items[len(items) - m :], items[: len(items) - m])
                self.turn ^= 1
                if level + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                self.levels[level + 1] = np.concatenate([self.levels[level + 1], free[self.turn :: 2]])
                self.levels[level] = kept
            level += 1

    def merge(self, other: Req) -> Req:
        require(self.spec == other.spec, "summaries of different parameters cannot be merged")
        self.n, self.min, self.max = self.n + other.n, min(self.min, other.min), max(self.max, other.max)
        self.levels += [np.zeros(0)] * (len(other.levels) - len(self.levels))
        for i, x in enumerate(other.levels):
            self.levels[i] = np.concatenate([self.levels[i], x])
        self.compact()
        return self

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 2.0**i) for i, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantile(self, rank: float) -> float | None:
        require(0 <= rank <= 1, "a rank lies between 0 and 1")
        if not self.n:
            return None
        if rank in (0, 1):
            return self.max if rank else self.min
        values, sums = self.weighted()
        return float(values[min(np.searchsorted(sums, rank * sums[-1]), len(values) - 1)])

    def rank(self, value: float) -> float:
        if not self.n:
            return 0.0
        values, sums = self.weighted()
        at = np.searchsorted(values, value, side="right")
        return float(sums[at - 1] / sums[-1]) if at else 0.0

    def cdf(self, splits: list[float]) -> list[float]:
        return [self.rank(s) for s in splits] + [1.0] if self.n else [0.0] * (len(splits) + 1)

    def pmf(self, splits: list[float]) -> list[float]:
        cdf = self.cdf(splits)
        return [b - a for a, b in zip([0.0, *cdf], cdf, strict=False)]

    @property
    def retained(self) -> int:
        return sum(map(len, self.levels))

    def to_bytes(self) -> bytes:
        head = struct.pack("<IBQddBI", self.spec.k, self.spec.mode == "HRA", self.n, self.min, self.max, self.turn, len(self.levels))
        return pack("req", head + b"".join(struct.pack("<I", len(x)) + x.astype("<f8").tobytes() for x in self.levels))

    @classmethod
    def from_bytes(cls, data: bytes) -> Req:
        body = unpack("req", data)
        k, high, n, low, top, turn, count = struct.unpack_from("<IBQddBI", body)
        out = cls(ReqSpec(k, "HRA" if high else "LRA"))
        out.n, out.min, out.max, out.turn, out.levels, at = n, low, top, turn, [], struct.calcsize("<IBQddBI")
        for _ in range(count):
            (size,) = struct.unpack_from("<I", body, at)
            out.levels.append(np.frombuffer(body, "<f8", size, at + 4).copy())
            at += 4 + 8 * size
        return out


# -- t-digest -------------------------------------------------------------------------------------------------------------


class TDigest:
    """Merging t-digest with the arcsine scale: centroids may span one unit of compression / (2 pi) * asin(2 q - 1)."""

    def __init__(self, spec: TDigestSpec = TDigestSpec()):
        self.spec, self.n, self.min, self.max = spec, 0, math.inf, -math.inf
        self.means, self.weights = np.zeros(0), np.zeros(0)

    def _squeeze(self, means: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(means, kind="stable")
        means, weights = means[order], weights[order]
        scale = self.spec.compression / (2 * math.pi)
        middle = (np.cumsum(weights) - weights / 2) / max(weights.sum(), 1e-300)
        unit = np.floor(scale * np.arcsin(np.clip(2 * middle - 1, -1, 1)) * 2).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]])) if len(unit) else np.zeros(0, np.int64)
        if not len(first):
            return
        w = np.add.reduceat(weights, first)
        self.means, self.weights = np.add.reduceat(means * weights, first) / w, w

    def add(self, values: np.ndarray) -> TDigest:
        values = values[~np.isnan(values)]
        if len(values):
            self.n += len(values)
            self.min, self.max = min(self.min, float(values.min())), max(self.max, float(values.max()))
            self._squeeze(np.concatenate([self.means, values]), np.concatenate([self.weights, np.ones(len(values))]))
        return self

    def merge(self, other: TDigest) -> TDigest:
        require(self.spec == other.spec, "summaries of different parameters cannot be merged")
        self.n, self.min, self.max = self.n + other.n, min(self.min, other.min), max(self.max, other.max)
        self._squeeze(np.concatenate([self.means, other.means]), np.concatenate([self.weights, other.weights]))
        return self

    def _knots(self) -> tuple[np.ndarray, np.ndarray]:
        sums = np.cumsum(self.weights)
        at = np.concatenate([[0.0], (sums - self.weights / 2) / sums[-1], [1.0]])
        return at, np.concatenate([[self.min], self.means, [self.max]])

    def quantile(self, q: float) -> float | None:
        if not self.n:
            return None
        if q <= 0 or q >= 1:
            return self.min if q <= 0 else self.max
        at, value = self._knots()
        return float(np.interp(q, at, value))

    def rank(self, x: float) -> float | None:
        if not self.n:
            return None
        if x <= self.min or x >= self.max:
            return 0.0 if x <= self.min else 1.0
        at, value = self._knots()
        return float(np.interp(x, value, at))

    def trimmed_mean(self, low: float, high: float) -> float | None:
        """Mean of 1001 quantiles between the two ranks."""
        if not self.n or low >= high:
            return None
        at, value = self._knots()
        return float(np.interp(np.linspace(max(0.0, low), min(1.0, high), 1001), at, value).mean())

    def to_bytes(self) -> bytes:
        head = struct.pack("<dQddI", self.spec.compression, self.n, self.min, self.max, len(self.means))
        return pack("tdigest", head + self.means.astype("<f8").tobytes() + self.weights.astype("<f8").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> TDigest:
        body = unpack("tdigest", data)
        compression, n, low, top, size = struct.unpack_from("<dQddI", body)
        out, at = cls(TDigestSpec(compression)), struct.calcsize("<dQddI")
        out.n, out.min, out.max = n, low, top
        out.means, out.weights = np.frombuffer(body, "<f8", size, at).copy(), np.frombuffer(body, "<f8", size, at + 8 * size).copy()
        return out


# -- both as aggregates ---------------------------------------------------------------------------------------------------


def build(df: DataFrame, value: str, keys: list[str], make: Callable, parse: Callable, fan_in: int = 32) -> DataFrame:
    """keys.., sketch: one state per key. make() is an empty state, parse(bytes) a stored one."""
    kinds = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "sketch binary"])
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where("_x is not null")

    def local(batches):
        states: dict = {}
        for b in batches:
            groups = b.groupby(keys, dropna=False, sort=False)["_x"] if keys else [((), b["_x"])]
            for key, x in groups:
                key = key if isinstance(key, tuple) else (key,)
                states.setdefault(key, make()).add(x.to_numpy())
            if len(states) > 50_000:
                yield frame(states)
                states = {}
        if states:
            yield frame(states)

    def frame(states: dict) -> pd.DataFrame:
        out = pd.DataFrame([(*k, s.to_bytes()) for k, s in states.items()], columns=[*keys, "sketch"])
        return out

    parts = rows.mapInPandas(local, kinds)
    return merge_states(parts, keys, parse, fan_in)


def merge_states(states: DataFrame, keys: list[str], parse: Callable, fan_in: int = 32) -> DataFrame:
    """One state per key. A first round brings the states of a key down to at most fan_in (and, where the cluster has more slots than fan_in squared, a round before
    it to fan_in squared), so no task gathers a state from every task of a large job."""
    kinds = ", ".join([*(f"`{k}` {states.schema[k].dataType.simpleString()}" for k in keys), "sketch binary"])

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        total = parse(b["sketch"].iloc[0])
        for s in b["sketch"].iloc[1:]:
            total.merge(parse(s))
        out = b[keys].iloc[:1].copy() if keys else pd.DataFrame(index=[0])
        out["sketch"] = [total.to_bytes()]
        return out

    slots = states.sparkSession.sparkContext.defaultParallelism
    once = states
    for groups in [fan_in * fan_in] * (slots > fan_in * fan_in) + [fan_in]:
        once = once.withColumn("_s", F.spark_partition_id() % groups).groupBy(*keys, "_s").applyInPandas(lambda b: merge(b), kinds)
    return (once.groupBy(*keys) if keys else once.groupBy(F.lit(True).alias("_one"))).applyInPandas(lambda b: merge(b), kinds)


def req_build(df: DataFrame, value: str, keys: list[str], spec: ReqSpec = ReqSpec()) -> DataFrame:
    return build(df, value, keys, lambda: Req(spec), Req.from_bytes)


def tdigest_build(df: DataFrame, value: str, keys: list[str], spec: TDigestSpec = TDigestSpec()) -> DataFrame:
    return build(df, value, keys, lambda: TDigest(spec), TDigest.from_bytes)


def ask(states: DataFrame, keys: list[str], parse: Callable, questions: dict[str, Callable]) -> DataFrame:
    """keys.. and one double per question, a function of the parsed state."""

    def run(batches):
        for b in batches:
            parsed = [parse(s) for s in b["sketch"]]
            out = b[keys].copy()
            for name, f in questions.items():
                out[name] = [f(s) for s in parsed]
            yield out

    kinds = ", ".join([*(f"`{k}` {states.schema[k].dataType.simpleString()}" for k in keys), *(f"`{n}` double" for n in questions)])
    return states.select(*keys, "sketch").mapInPandas(run, kinds)


def statistics(states: DataFrame, keys: list[str], parse: Callable) -> DataFrame:
    """keys.., n, min, max, retained (items or centroids kept), levels and bytes of each stored state."""
    kept = lambda s: float(s.retained if isinstance(s, Req) else len(s.means))
    levels = lambda s: float(len(s.levels) if isinstance(s, Req) else 1)
    asked = ask(states, keys, parse, {"n": lambda s: float(s.n), "min": lambda s: s.min, "max": lambda s: s.max, "retained": kept, "levels": levels, "bytes": lambda s: float(len(s.to_bytes()))})
    return asked.select(*keys, "min", "max", *[F.col(c).cast("bigint").alias(c) for c in ("n", "retained", "levels", "bytes")])
