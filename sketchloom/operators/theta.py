"""Theta, tuple and array-of-doubles summaries: the smallest hashes of each key, with what belongs to them.

A state has rows (keys.., h, theta, values..): the k smallest distinct hashes h of each key, all below theta, which is the (k + 1)-th
hash or 2^60 where fewer were seen. This canonical form does not depend on the order of arrival. Set operations are joins on h.

Hashes that cannot be kept are screened out before the shuffle: a cheap HyperLogLog++ count per key (standard error 5 %) bounds theta
from above at twice its expected value, 20 standard errors away. So about 2 k hashes of a key reach its task, however many it has. The bounds of
the MOST_KEYS keys with most hashes are broadcast; rows of other keys, each of which has fewer, are not screened. Rows are never shuffled for the screen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BITS, FAST, SPAN, Hasher, as_column, present
from ..functions.spec import AodSpec, ThetaSpec, require
from .cardinality import d

FULL = 1 << BITS
MOST_KEYS = 50_000


def _smallest(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k smallest h of each key with theta; one row per key and h in ``rows``."""
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("h")
    ranked = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    last = F.max(F.when(F.col("_n") == k + 1, F.col("h"))).over(whole)
    top = F.col("theta") if "theta" in rows.columns else F.lit(FULL)
    out = ranked.withColumn("theta", F.least(F.min(top).over(whole), F.coalesce(last, F.lit(FULL)))).where((F.col("_n") <= k) & (F.col("h") < F.col("theta")))
    return out.drop("_n")


def _screened(hashed: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows whose hash may be among the k + 1 smallest of their key."""
    size = hashed.groupBy(*keys).agg(F.approx_count_distinct("h", 0.05).alias("_n"))
    large = size.where(F.col("_n") > 2 * (k + 64)).orderBy(F.desc("_n")).limit(MOST_KEYS)
    bound = large.select(*keys, (d(2.0 * (k + 64) * SPAN) / F.col("_n").cast("double")).cast("bigint").alias("_top"))
    joined = hashed.join(F.broadcast(bound), keys or F.lit(True), "left")  # at most MOST_KEYS rows; one row without keys
    return joined.where(F.col("_top").isNull() | (F.col("h") < F.col("_top"))).drop("_top")


def _build(hashed: DataFrame, keys: list[str], k: int, aggs: list[Column], screen: bool) -> DataFrame:
    rows = _screened(hashed, keys, k) if screen else hashed
    return _smallest(rows.groupBy(*keys, "h").agg(*aggs) if aggs else rows.select(*keys, "h").distinct(), keys, k)


def theta_build(df: DataFrame, item: str | Column, keys: list[str], spec: ThetaSpec = ThetaSpec(), hasher: Hasher = FAST, screen: bool = True) -> DataFrame:
    hashed = present(df, item).select(*keys, hasher.h60(item).alias("h"))
    return _build(hashed, keys, spec.nominal, [], screen)


def theta_estimate(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys.., retained, theta, estimate: exact below k, else (n - 1) / theta."""
    n, top = F.count(F.lit(1)), F.coalesce(F.min("theta"), F.lit(FULL))
    est = F.when(top == FULL, n.cast("double")).otherwise((n - 1).cast("double") / (top.cast("double") / d(SPAN)))
    return state.groupBy(*keys).agg(n.alias("retained"), top.alias("theta"), est.alias("estimate"))


def theta_union(a: DataFrame, b: DataFrame, keys: list[str], spec: ThetaSpec = ThetaSpec()) -> DataFrame:
    both = a.select(*keys, "h", "theta").unionByName(b.select(*keys, "h", "theta"))
    return _smallest(both.groupBy(*keys, "h").agg(F.min("theta").alias("theta")), keys, spec.nominal)


def theta_union_many(states: list[DataFrame], keys: list[str], spec: ThetaSpec = ThetaSpec()) -> DataFrame:
    """Union of any number of states in one aggregation."""
    require(bool(states), "there are no states to merge")
    rows = reduce(lambda a, b: a.unionByName(b), [s.select(*keys, "h", "theta") for s in states])
    return _smallest(rows.groupBy(*keys, "h").agg(F.min("theta").alias("theta")), keys, spec.nominal)


def theta_intersect_many(states: list[DataFrame], keys: list[str]) -> DataFrame:
    """Hashes that every state holds, below the smallest theta of all; one aggregation."""
    require(bool(states), "there are no states to intersect")
    rows = reduce(lambda a, b: a.unionByName(b), [s.select(*keys, "h", "theta", F.lit(i).alias("_i")) for i, s in enumerate(states)])
    least = rows.groupBy(*keys).agg(F.min("theta").alias("_t"))
    held = rows.groupBy(*keys, "h").agg(F.count_distinct("_i").alias("_n")).where(F.col("_n") == len(states))
    joined = held.join(least, keys) if keys else held.crossJoin(F.broadcast(least))  # no keys: one row
    return joined.where(F.col("h") < F.col("_t")).select(*keys, "h", F.col("_t").alias("theta"))


def _with_theta(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a with the smaller theta of both sides; a key that b lacks keeps its own."""
    other = b.groupBy(*keys).agg(F.min("theta").alias("_t"))
    joined = a.join(other, keys, "left") if keys else a.crossJoin(F.broadcast(other))  # no keys: one row
    return joined.withColumn("theta", F.least("theta", F.coalesce("_t", F.lit(FULL)))).drop("_t").where(F.col("h") < F.col("theta"))


def theta_intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _with_theta(a, b, keys).join(b.select(*keys, "h"), [*keys, "h"], "left_semi")


def theta_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _with_theta(a, b, keys).join(b.select(*keys, "h"), [*keys, "h"], "left_anti")


def theta_jaccard(a: DataFrame, b: DataFrame, spec: ThetaSpec = ThetaSpec()) -> DataFrame:
    """jaccard of two states without keys: the share of the union's smallest hashes that both have."""
    union = theta_union(a, b, [], spec)
    both = a.select("h").join(b.select("h"), "h", "left_semi").withColumn("both", F.lit(1))
    return union.join(both, "h", "left").agg((F.count("both").cast("double") / F.count(F.lit(1)).cast("double")).alias("jaccard"))


def native_theta(df: DataFrame, item: str, keys: list[str], lg_k: int = 12) -> DataFrame:
    return df.groupBy(*keys).agg(F.theta_sketch_agg(item, lg_k).alias("sketch"))


# -- tuple: a summary per hash --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Summary:
    """What stands beside a hash. make: aggregate of the rows' values; merge: aggregate of states; put: of two sides in an intersection."""

    make: Callable[[Column], Column]
    merge: Callable[[Column], Column]
    put: Callable[[Column, Column], Column]


def _plus(x: Column, y: Column) -> Column:
    return x + y


def array_sum(n: int) -> Summary:
    """Sums of arrays of n doubles, place by place."""
    def add(c: Column) -> Column:
        return F.array(*[F.sum(c[i].cast("double")) for i in range(n)])

    return Summary(add, add, lambda x, y: F.zip_with(x, y, _plus))


SUMMARIES = {"sum": Summary(F.sum, F.sum, _plus), "count": Summary(F.count, F.sum, _plus), "min": Summary(F.min, F.min, F.least), "max": Summary(F.max, F.max, F.greatest)}


def summary(how: str | Summary) -> Summary:
    return SUMMARIES[how] if isinstance(how, str) else how


def tuple_build(
    df: DataFrame, item: str | Column, summaries: dict[str, tuple[str | Summary, str | Column]], keys: list[str], spec: ThetaSpec = ThetaSpec(), hasher: Hasher = FAST
) -> DataFrame:
    """summaries: name -> (sum | count | min | max or a Summary, column). Every kept hash has its whole summary: all rows are aggregated per hash before any hash is let go."""
    values = [as_column(c).alias(f"_v{i}") for i, (_, c) in enumerate(summaries.values())]
    hashed = present(df, item).select(*keys, hasher.h60(item).alias("h"), *values)
    aggs = [summary(how).make(F.col(f"_v{i}")).alias(name) for i, (name, (how, _)) in enumerate(summaries.items())]
    return _build(hashed, keys, spec.nominal, aggs, True)


def tuple_union(a: DataFrame, b: DataFrame, summaries: dict[str, str | Summary], keys: list[str], spec: ThetaSpec = ThetaSpec()) -> DataFrame:
    cols = [*keys, "h", "theta", *summaries]
    both = a.select(cols).unionByName(b.select(cols))
    merged = both.groupBy(*keys, "h").agg(F.min("theta").alias("theta"), *[summary(how).merge(F.col(n)).alias(n) for n, how in summaries.items()])
    return _smallest(merged, keys, spec.nominal)


def tuple_intersect(a: DataFrame, b: DataFrame, summaries: dict[str, str | Summary], keys: list[str]) -> DataFrame:
    right = b.select(*keys, "h", *[F.col(n).alias(f"_{n}") for n in summaries])
    joined = _with_theta(a, b, keys).join(right, [*keys, "h"])
    return joined.select(*keys, "h", "theta", *[summary(how).put(F.col(n), F.col(f"_{n}")).alias(n) for n, how in summaries.items()])


def tuple_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return theta_difference(a, b, keys)


def tuple_get(state: DataFrame, items: DataFrame, item: str, hasher: Hasher = FAST) -> DataFrame:
    """The distinct items asked for with their summaries; null where the item was never seen or was let go. For a state without keys."""
    asked = items.select(F.col(item)).where(F.col(item).isNotNull()).distinct().withColumn("h", hasher.h60(item))
    return asked.join(state.drop("theta"), "h", "left").drop("h")


def tuple_map(state: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys.., summaries: a map from hash to its summaries, at most k entries a key."""
    return state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("h", F.struct(*names)))).alias("summaries"))


def tuple_estimate(state: DataFrame, keys: list[str], sums: list[str] = ()) -> DataFrame:
    """As theta_estimate, and for each summary in ``sums`` its total over all items, scaled by theta."""
    n, top = F.count(F.lit(1)), F.coalesce(F.min("theta"), F.lit(FULL))
    part = top.cast("double") / d(SPAN)
    est = F.when(top == FULL, n.cast("double")).otherwise((n - 1).cast("double") / part)
    return state.groupBy(*keys).agg(n.alias("retained"), est.alias("estimate"), *[(F.sum(s).cast("double") / part).alias(f"total_{s}") for s in sums])


# -- array of doubles -----------------------------------------------------------------------------------------------------


def aod_build(df: DataFrame, item: str | Column, values: list[str], order: str, keys: list[str], spec: AodSpec, hasher: Hasher = FAST) -> DataFrame:
    """(keys.., h, theta, values, seq): per hash the values of its last row by ``order`` (last write wins). A key over its capacity
    keeps the smallest 3/4 of the capacity."""
    if len(values) != spec.num_values:
        raise ValueError(f"{spec.num_values} values are expected, not {len(values)}")
    vector = F.array(*[F.col(v).cast("double") for v in values])
    hashed = present(df, item).select(*keys, hasher.h60(item).alias("h"), vector.alias("_v"), F.col(order).alias("_o"))
    last = _screened(hashed, keys, spec.capacity).groupBy(*keys, "h").agg(F.max_by("_v", "_o").alias("values"), F.max("_o").alias("seq"))
    return _aod_trim(last, keys, spec)


def _aod_trim(rows: DataFrame, keys: list[str], spec: AodSpec) -> DataFrame:
    whole = Window.partitionBy(*(keys or [F.lit(1)]))
    keep = spec.capacity * 3 // 4
    ranked = rows.withColumn("_n", F.row_number().over(whole.orderBy("h"))).withColumn("_all", F.count(F.lit(1)).over(whole))
    edge = F.max(F.when((F.col("_all") > spec.capacity) & (F.col("_n") == keep + 1), F.col("h"))).over(whole)
    top = F.min("theta").over(whole) if "theta" in rows.columns else F.lit(FULL)
    return ranked.withColumn("theta", F.least(top, F.coalesce(edge, F.lit(FULL)))).where(F.col("h") < F.col("theta")).drop("_n", "_all")


def aod_union(a: DataFrame, b: DataFrame, keys: list[str], spec: AodSpec) -> DataFrame:
    """Where both have a hash, b's values stand."""
    tag = lambda s, i: s.select(*keys, "h", "theta", "values", "seq", F.lit(i).alias("_side"))
    both = tag(a, 0).unionByName(tag(b, 1))
    merged = both.groupBy(*keys, "h").agg(F.min("theta").alias("theta"), F.max_by("values", "_side").alias("values"), F.max_by("seq", "_side").alias("seq"))
    least = Window.partitionBy(*(keys or [F.lit(1)]))
    level = merged.withColumn("theta", F.min("theta").over(least)).where(F.col("h") < F.col("theta"))
    return _aod_trim(level, keys, spec)


Z = {0.99: 2.576, 0.95: 1.96, 0.90: 1.645}


def aod_estimate(state: DataFrame, keys: list[str], spec: AodSpec, confidence: float = 0.95) -> DataFrame:
    """keys.., entries, theta, estimate, lower, upper, sums, means (arrays over the values)."""
    n, part = F.count(F.lit(1)).cast("double"), F.min("theta").cast("double") / d(SPAN)
    est = n / part
    spread = d(Z.get(confidence, 1.0)) * F.sqrt(est * (d(1.0) - part) / part)
    sums = F.array(*[F.sum(F.col("values")[i]) / part for i in range(spec.num_values)])
    means = F.array(*[F.sum(F.col("values")[i]) / n for i in range(spec.num_values)])
    return state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"), part.alias("theta"), est.alias("estimate"), F.greatest(d(0.0), est - spread).alias("lower"), (est + spread).alias("upper"), sums.alias("sums"), means.alias("means")
    )
