"""Distinct counts as state tables: rows (keys.., slot, value), one per touched slot.

Every family has build -> merge -> estimate. Building is one hash aggregation with map-side combine, so at most one row per key, slot and
task is shuffled however often an item repeats; merging is a union and the same aggregation (associative and idempotent);
estimating is one aggregation of the state. The sparse form of a summary is the state itself, the dense form dense_registers().
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BITS, FAST, Hasher, as_column, bit_length, power2, present
from ..functions.spec import CpcSpec, HllSpec, HybridSpec, LinearSpec, require

# Thresholds of linear counting for p = 4 to 18.
HLLPP_THRESHOLDS = [10.0, 20.0, 40.0, 80.0, 220.0, 400.0, 900.0, 1800.0, 3100.0, 6500.0, 11500.0, 20000.0, 50000.0, 120000.0, 350000.0]

# Published coefficients of the ICON polynomial for lg_k = 11.
ICON_11 = [
    0.9999186020796150265, 0.3333249054574359826, 0.126791713589799987, -0.06662487271699729652, -0.07335552427910230211,
    0.3316370184815959909, -1.434143797561290068, 4.180260309967409604, -8.593906870708760692, 12.95088874800289958,
    -14.56876092520539956, 12.37074367531410068, -7.969152075707960137, 3.888774396648960074, -1.424923326506990051,
    0.385084561785229984, -0.07435541911616409816, 0.009695363567476529554, -0.0007644375960047160388, 2.75156194717188011e-05,
]


def d(x: float) -> Column:
    """A double literal (an untyped decimal literal would change the arithmetic)."""
    return F.lit(float(x))


# -- HLL ------------------------------------------------------------------------------------------------------------------


def hll_coupons(df: DataFrame, item: str | Column, keys: list[str], spec: HllSpec = HllSpec(), hasher: Hasher = FAST) -> DataFrame:
    """(keys.., idx, rank): the first p bits of the hash, and the position of the first one in the rest."""
    rest = BITS - spec.p
    hashed = present(df, item).select(*keys, hasher.h60(item).alias("h"))
    low = F.col("h").bitwiseAND((1 << rest) - 1)
    return hashed.select(*keys, F.shiftright("h", rest).cast("int").alias("idx"), (F.lit(rest + 1) - bit_length(low)).cast("int").alias("rank"))


def hll_build(df: DataFrame, item: str | Column, keys: list[str], spec: HllSpec = HllSpec(), hasher: Hasher = FAST) -> DataFrame:
    return hll_combine(hll_coupons(df, item, keys, spec, hasher), keys)


def hll_combine(states: DataFrame, keys: list[str]) -> DataFrame:
    """Registers of the given keys (a subset of the state's: a roll-up)."""
    return states.groupBy(*keys, "idx").agg(F.max("rank").alias("rank"))


def hll_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return hll_combine(a.select(*keys, "idx", "rank").unionByName(b.select(*keys, "idx", "rank")), keys)


def hll_fold(state: DataFrame, keys: list[str], source: HllSpec, target: HllSpec) -> DataFrame:
    """The same summary at a smaller p, equal to building it there: the index bits cut off become the head of the rest."""
    require(target.p <= source.p, "a summary can only be folded to a smaller p")
    cut = source.p - target.p
    head = F.col("idx").bitwiseAND((1 << cut) - 1)
    rank = F.when(head > 0, F.lit(cut + 1) - bit_length(head.cast("bigint"))).otherwise(F.lit(cut) + F.col("rank"))
    return hll_combine(state.select(*keys, F.shiftright("idx", cut).alias("idx"), rank.cast("int").alias("rank")), keys)


def hll_union(a: DataFrame, spec_a: HllSpec, b: DataFrame, spec_b: HllSpec, keys: list[str], most: HllSpec) -> tuple[DataFrame, HllSpec]:
    """Union of summaries of different p at the smallest of both and ``most``; mixed p is never merged slot by slot."""
    target = HllSpec(min(spec_a.p, spec_b.p, most.p))
    return hll_merge(hll_fold(a, keys, spec_a, target), hll_fold(b, keys, spec_b, target), keys), target


def alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1.0 + 1.079 / m))


def _raw(m: int) -> tuple[Column, Column, Column]:
    """Columns over the registers of a key: number of zeros, raw estimate, linear count."""
    zeros = d(m) - F.count(F.lit(1)).cast("double")
    total = F.coalesce(F.sum(power2(-F.col("rank"))), d(0.0)) + zeros
    return zeros, d(alpha(m) * m * m) / total, d(m) * F.log(d(m) / F.when(zeros > 0, zeros).otherwise(d(1.0)))


def hll_estimate(state: DataFrame, keys: list[str], spec: HllSpec = HllSpec(), name: str = "estimate") -> DataFrame:
    """Raw estimate, or linear counting where that is at most 2.5 m and registers are empty."""
    zeros, raw, linear = _raw(spec.m)
    return state.groupBy(*keys).agg(F.when((raw <= d(2.5 * spec.m)) & (zeros > 0), linear).otherwise(raw).alias(name))


def hllpp_estimate(state: DataFrame, keys: list[str], spec: HllSpec = HllSpec(), name: str = "estimate") -> DataFrame:
    """Linear counting up to the threshold of p, the raw estimate beyond it."""
    zeros, raw, linear = _raw(spec.m)
    limit = d(HLLPP_THRESHOLDS[min(max(spec.p - 4, 0), 14)])
    return state.groupBy(*keys).agg(F.when((zeros > 0) & (linear <= limit), linear).otherwise(raw).alias(name))


def hll_mode(slots: Column, spec: HllSpec) -> Column:
    """LIST, SET or HLL, by the number of distinct slots."""
    to_set = F.when(slots < 8, "LIST")
    if spec.p <= 8:
        return to_set.otherwise("HLL")
    return to_set.when(slots * 4 <= 3 * (1 << (spec.p - 4)), "SET").otherwise("HLL")


def hll_modes(state: DataFrame, keys: list[str], spec: HllSpec) -> DataFrame:
    """keys.., mode, slots, estimate: the slot count in the small modes, the raw estimate in HLL mode."""
    zeros, raw, linear = _raw(spec.m)
    slots = F.count(F.lit(1))
    mode = hll_mode(slots, spec)
    est = F.when((raw <= d(2.5 * spec.m)) & (zeros > 0), linear).otherwise(raw)
    return state.groupBy(*keys).agg(mode.alias("mode"), slots.alias("slots"), F.when(mode == "HLL", est).otherwise(slots.cast("double")).alias("estimate"))


def hll_density(state: DataFrame, keys: list[str], spec: HllSpec, ratio: float = 0.7, bytes_per_entry: int = 33) -> DataFrame:
    """keys.., entries, is_sparse: whether the sparse form is at most ``ratio`` of the dense one."""
    require(0 < ratio <= 1, "ratio must be in (0, 1]")
    n = F.count(F.lit(1))
    return state.groupBy(*keys).agg(n.alias("entries"), (n * bytes_per_entry <= d(ratio * spec.m)).alias("is_sparse"))


def dense_registers(state: DataFrame, keys: list[str], spec: HllSpec) -> DataFrame:
    """All m registers of every key, zeros included."""
    slots = F.explode(F.sequence(F.lit(0), F.lit(spec.m - 1))).alias("idx")
    every = state.select(*keys).distinct().select(*keys, slots) if keys else state.sparkSession.range(spec.m).select(F.col("id").cast("int").alias("idx"))
    return every.join(state, [*keys, "idx"], "left").select(*keys, "idx", F.coalesce("rank", F.lit(0)).alias("rank"))


def native_hll(df: DataFrame, item: str, keys: list[str], lg_k: int = 12) -> DataFrame:
    """Spark's own aggregate: one pass, binary state; merge with hll_union_agg."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(item, lg_k).alias("sketch"))


# -- CPC ------------------------------------------------------------------------------------------------------------------


def cpc_build(df: DataFrame, item: str | Column, keys: list[str], spec: CpcSpec = CpcSpec(), hasher: Hasher = FAST) -> DataFrame:
    """(keys.., row, bits): the coupons (row, column) of each row as one bit mask."""
    h = present(df, item).select(*keys, hasher.h60(item).alias("h"), hasher.h60(item, "cpc:").alias("g"))
    col = (F.lit(BITS) - bit_length(F.col("g"))).cast("int")
    coupons = h.select(*keys, F.col("h").bitwiseAND(spec.k - 1).cast("int").alias("row"), F.expr("shiftleft(1L, 0)").alias("one"), col.alias("c"))
    return cpc_combine(coupons.select(*keys, "row", F.call_function("shiftleft", F.col("one"), F.col("c")).alias("bits")), keys)


def cpc_combine(states: DataFrame, keys: list[str]) -> DataFrame:
    return states.groupBy(*keys, "row").agg(F.bit_or("bits").alias("bits"))


def cpc_union(a: DataFrame, spec_a: CpcSpec, b: DataFrame, spec_b: CpcSpec, keys: list[str]) -> tuple[DataFrame, CpcSpec]:
    """Union at the smaller lg_k: rows are cut to its bits."""
    spec = CpcSpec(min(spec_a.lg_k, spec_b.lg_k))
    cut = lambda s: s.select(*keys, F.col("row").bitwiseAND(spec.k - 1).alias("row"), "bits")
    return cpc_combine(cut(a).unionByName(cut(b)), keys), spec


def cpc_flavor(coupons: Column, spec: CpcSpec) -> Column:
    k = spec.k
    return (
        F.when(coupons == 0, "Empty").when(coupons * 32 < 3 * k, "Sparse").when(coupons * 2 < k, "Hybrid").when(coupons * 8 < 27 * k, "Pinned").otherwise("Sliding")
    )


def icon_polynomial(coupons: Column, spec: CpcSpec) -> Column:
    """ICON estimate for lg_k = 11 by the published polynomial, never under the number of coupons."""
    c, k = coupons.cast("double"), float(spec.k)
    x, value = c / d(2.0 * k), d(ICON_11[-1])
    for a in reversed(ICON_11[:-1]):
        value = value * x + d(a)
    ratio = c / d(k)
    curve = c * value * (d(1.0) + ratio * ratio * ratio / d(66.774757))
    tail = d(0.7940236163830469 * k) * power2(ratio)
    return F.when(c < 2, c).otherwise(F.greatest(F.when(c > d(5.7 * k), tail).otherwise(curve), c))


def icon_inverse(coupons: float | np.ndarray, lg_k: int) -> float | np.ndarray:
    """ICON by its definition: the number of items at which that many coupons are expected, never under the number of coupons. Newton steps on the logarithm
    of the number (of which the expectation is a smooth, growing function), side by side for an array."""
    k = 1 << lg_k
    c = np.atleast_1d(np.asarray(coupons, dtype=float))
    logs = np.log1p(-(2.0 ** -(np.minimum(np.arange(64), 62) + 1.0)) / k)
    n = np.maximum(c, 2.0) * np.where(c > 3 * k, np.exp2(np.clip(c / k - 4.0, 0, 58)), 1.0)
    low, high = np.maximum(c, 1.0), np.full_like(c, 2.0**80)
    for _ in range(200):
        missed = np.exp(n[:, None] * logs)
        value, slope = k * (1 - missed).sum(axis=1), -k * (missed * logs).sum(axis=1)
        low, high = np.where(value < c, n, low), np.where(value >= c, n, high)
        step = n * np.exp(np.clip((c - value) / np.maximum(slope * n, 1e-300), -2, 2))
        fresh = np.where((step > low) & (step < high), step, np.sqrt(low * high))
        if (np.abs(fresh - n) <= 1e-13 * n).all():
            break
        n = fresh
    out = np.where(c < 2, c, np.maximum(n, c))
    return float(out[0]) if np.ndim(coupons) == 0 else out


def cpc_estimate(state: DataFrame, keys: list[str], spec: CpcSpec = CpcSpec()) -> DataFrame:
    """keys.., coupons, flavor, estimate. For lg_k other than 11 one number per key goes through icon_inverse."""
    counted = state.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias("coupons"))
    flavored = counted.withColumn("flavor", cpc_flavor(F.col("coupons"), spec))
    if spec.lg_k == 11:
        return flavored.withColumn("estimate", icon_polynomial(F.col("coupons"), spec))

    @F.pandas_udf("double")
    def invert(coupons: pd.Series) -> pd.Series:
        return pd.Series(icon_inverse(coupons.to_numpy(dtype=float), spec.lg_k))

    return flavored.withColumn("estimate", invert("coupons"))


# -- linear and hybrid counters -------------------------------------------------------------------------------------------


def linear_build(df: DataFrame, item: str | Column, keys: list[str], spec: LinearSpec, hasher: Hasher = FAST) -> DataFrame:
    """(keys.., bit): the distinct bits set."""
    return present(df, item).select(*keys, (hasher.h60(item) % spec.m).cast("int").alias("bit")).distinct()


def linear_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def linear_estimate(state: DataFrame, keys: list[str], spec: LinearSpec) -> DataFrame:
    """keys.., num_bits, bits_set, fill_ratio, estimate, should_transition. A full array counts as 1.5 m."""
    m, used = spec.m, F.count(F.lit(1)).cast("double")
    est = F.when(used >= m, d(1.5 * m)).otherwise(d(-m) * F.log((d(m) - used) / d(m)))
    fill = used / d(m)
    return state.groupBy(*keys).agg(
        F.lit(m).cast("bigint").alias("num_bits"), F.count(F.lit(1)).alias("bits_set"), fill.alias("fill_ratio"), est.alias("estimate"),
        ((fill > d(0.3)) | (est > d(0.1 * m))).alias("should_transition"),
    )


def hybrid_build(df: DataFrame, item: str | Column, keys: list[str], spec: HybridSpec, hasher: Hasher = FAST) -> DataFrame:
    """(keys.., part, idx, rank): bits of the linear counter (part 0) and registers of the HLL (part 1). Both are kept, so nothing seen before the
    switch is lost and states merge whatever their modes. One pass over the input: both slots are read off the same rows."""
    rest = BITS - spec.hll.p
    h = present(df, item).select(*keys, hasher.h60(item).alias("h"))
    rank = (F.lit(rest + 1) - bit_length(F.col("h").bitwiseAND((1 << rest) - 1))).cast("int")
    both = h.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), (F.col("h") % spec.linear.m).cast("int").alias("idx"), F.lit(0).alias("rank")),
                F.struct(F.lit(1).alias("part"), F.shiftright("h", rest).cast("int").alias("idx"), rank.alias("rank")),
            )
        ).alias("s"),
    )
    return hybrid_combine(both.select(*keys, "s.*"), keys)


def hybrid_combine(states: DataFrame, keys: list[str]) -> DataFrame:
    """States of the given keys (a subset of the state's: a roll-up)."""
    return states.groupBy(*keys, "part", "idx").agg(F.max("rank").alias("rank"))


def hybrid_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "part", "idx", "rank"]
    return hybrid_combine(a.select(cols).unionByName(b.select(cols)), keys)


def hybrid_statistics(state: DataFrame, keys: list[str], spec: HybridSpec) -> DataFrame:
    """keys.., mode, estimate, bits_set and fill_ratio (null beyond the switch), transition_threshold, memory_usage (bytes of the form that answers).
    The linear count answers while its rule holds, the HLL beyond it."""
    used = F.count_if(F.col("part") == 0).cast("double")
    m, k = float(spec.linear.m), float(spec.hll.m)
    linear = F.when(used >= d(m), d(1.5 * m)).otherwise(d(-m) * F.log((d(m) - used) / d(m)))
    zeros = d(k) - F.count_if(F.col("part") == 1).cast("double")
    raw = d(alpha(spec.hll.m) * k * k) / (F.sum(F.when(F.col("part") == 1, power2(-F.col("rank"))).otherwise(d(0.0))) + zeros)
    small = d(k) * F.log(d(k) / F.when(zeros > 0, zeros).otherwise(d(1.0)))
    hll = F.when((raw <= d(2.5 * k)) & (zeros > 0), small).otherwise(raw)
    stay = (used / d(m) <= d(0.3)) & (linear <= d(0.1 * m))
    return state.groupBy(*keys).agg(
        F.when(stay, "Linear Counter").otherwise("HyperLogLog").alias("mode"), F.when(stay, linear).otherwise(hll).alias("estimate"),
        F.when(stay, used.cast("bigint")).alias("bits_set"), F.when(stay, used / d(m)).alias("fill_ratio"),
        F.lit(spec.threshold).cast("bigint").alias("transition_threshold"), F.when(stay, spec.linear.m // 8).otherwise(spec.hll.m).cast("bigint").alias("memory_usage"),
    )


def hybrid_estimate(df: DataFrame, item: str | Column, keys: list[str], spec: HybridSpec, hasher: Hasher = FAST) -> DataFrame:
    """keys.., mode, estimate."""
    return hybrid_statistics(hybrid_build(df, item, keys, spec, hasher), keys, spec).select(*keys, "mode", "estimate")


WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4, "bigint": 8, "double": 8, "timestamp": 8}


def state_size(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., entries, memory_usage: rows of a state table of any family, and their bytes without the keys (strings and arrays by their length)."""
    width = F.lit(0).cast("bigint")
    for f in state.schema.fields:
        if f.name in keys:
            continue
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("array"):
            width = width + F.coalesce(F.size(c), F.lit(0)) * WIDTHS.get(kind[6:-1], 8)
        else:
            width = width + (WIDTHS[kind] if kind in WIDTHS else F.coalesce(F.octet_length(c.cast("string")), F.lit(0)))
    return state.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).cast("bigint").alias("memory_usage"))


def merge_many(states: list[DataFrame], combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any number of states of one family and parameters in one aggregation: ``combine`` is the family's (as hll_combine, cpc_combine or distinct)."""
    require(bool(states), "there are no states to merge")
    return combine(reduce(lambda a, b: a.unionByName(b), states))


def exact_distinct(df: DataFrame, item: str, keys: list[str], name: str = "exact") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(as_column(item)).alias(name))
