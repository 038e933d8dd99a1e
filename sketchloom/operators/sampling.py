"""Samples by hash order: deterministic, mergeable, and exactly uniform (or weighted) over any partitioning.

A uniform sample is the k smallest seeded hashes; the k largest ln(u) / w are a weighted sample without replacement (A-Res); VarOpt
keeps items heavier than tau and, of the lighter ones, a threshold sample by hash. Merging is the same selection over the union.
Without keys the selection is a top-k per task and one merge of k rows per task. With keys, rows that cannot be
chosen are dropped by a bound first (see screened). ``key`` must tell items apart; a null key or a weight of at most 0 is skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import FAST, SPAN, Hasher
from ..functions.spec import SampleSpec
from .cardinality import d

MOST_GROUPS = 50_000


def uniform_sample(df: DataFrame, key: str, spec: SampleSpec, seed: int = 0, hasher: Hasher = FAST) -> DataFrame:
    """df's columns and sample_hash: k rows, uniform without replacement (all rows where there are no more)."""
    hashed = df.where(F.col(key).isNotNull()).withColumn("sample_hash", hasher.h60(key, f"{seed}:"))
    return hashed.orderBy("sample_hash", key).limit(spec.k)


def merge_uniform(a: DataFrame, b: DataFrame, key: str, spec: SampleSpec) -> DataFrame:
    return a.unionByName(b).orderBy("sample_hash", key).limit(spec.k)


def uniform_state(df: DataFrame, key: str, spec: SampleSpec, seed: int = 0, hasher: Hasher = FAST) -> DataFrame:
    """A uniform sample whose rows also carry items_seen, so the statistics are read off the sample itself."""
    seen = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("items_seen"))
    return uniform_sample(df, key, spec, seed, hasher).crossJoin(F.broadcast(seen))  # one row


def merge_uniform_states(a: DataFrame, b: DataFrame, key: str, spec: SampleSpec) -> DataFrame:
    seen = a.agg(F.max("items_seen").alias("n")).unionByName(b.agg(F.max("items_seen").alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items_seen"))
    return merge_uniform(a.drop("items_seen"), b.drop("items_seen"), key, spec).crossJoin(F.broadcast(seen))  # one row


def state_statistics(state: DataFrame, spec: SampleSpec) -> DataFrame:
    """items_seen, sample_size, capacity, is_full of a sample made by uniform_state."""
    n = F.count(F.lit(1))
    return state.agg(F.coalesce(F.max("items_seen"), F.lit(0)).cast("bigint").alias("items_seen"), n.alias("sample_size"), F.lit(spec.k).cast("bigint").alias("capacity"), (n >= spec.k).alias("is_full"))


def uniform_sample_by(df: DataFrame, keys: list[str], key: str, spec: SampleSpec, seed: int = 0, hasher: Hasher = FAST) -> DataFrame:
    """A uniform sample of k rows per group. A group of n rows sends about 2 k + 128 of them to its task: rows over that quantile of hashes
    are dropped before the shuffle. The quantiles of the MOST_GROUPS largest groups are broadcast; smaller groups go whole, and no row is shuffled for the screen.
    Hashes are taken to be spread evenly: of distinct keys, not of a sample."""
    hashed = df.where(F.col(key).isNotNull()).withColumn("sample_hash", hasher.h60(key, f"{seed}:"))
    sizes = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 2 * (spec.k + 64)).orderBy(F.desc("_n")).limit(MOST_GROUPS)
    bound = sizes.select(*keys, (d(2.0 * SPAN * (spec.k + 64)) / F.col("_n")).cast("bigint").alias("_top"))
    joined = hashed.join(F.broadcast(bound), keys, "left")
    enough = joined.where(F.col("_top").isNull() | (F.col("sample_hash") < F.col("_top")))
    order = Window.partitionBy(*keys).orderBy("sample_hash", key)
    ranked = enough.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= spec.k)
    return ranked.drop("_top", "_r")


def sample_statistics(df: DataFrame, key: str, spec: SampleSpec, weight: str | None = None) -> DataFrame:
    """items_seen, sample_size, capacity, is_full of a sample of df, and total_weight where there are weights."""
    kept = df.where(F.col(key).isNotNull() & (F.col(weight) > 0 if weight else F.lit(True)))
    n = F.count(F.lit(1))
    more = [F.coalesce(F.sum(F.col(weight).cast("double")), d(0.0)).alias("total_weight")] if weight else []
    return kept.agg(n.alias("items_seen"), F.least(n, F.lit(spec.k).cast("bigint")).alias("sample_size"), F.lit(spec.k).cast("bigint").alias("capacity"), (n >= spec.k).alias("is_full"), *more)


def weighted_sample(df: DataFrame, key: str, weight: str, spec: SampleSpec, seed: int = 0, hasher: Hasher = FAST) -> DataFrame:
    """df's columns and sample_key = ln(u) / w, the k largest."""
    u = hasher.unit(key, f"{seed}:")
    keyed = df.where(F.col(key).isNotNull() & (F.col(weight) > 0)).withColumn("sample_key", F.log(u) / F.col(weight).cast("double"))
    return keyed.orderBy(F.desc("sample_key"), key).limit(spec.k)


def merge_weighted(a: DataFrame, b: DataFrame, key: str, spec: SampleSpec) -> DataFrame:
    return a.unionByName(b).orderBy(F.desc("sample_key"), key).limit(spec.k)


def varopt_tau(df: DataFrame, weight: str, spec: SampleSpec) -> DataFrame:
    """One row: tau, heavy, n, total. With the weights in descending order, the first i items are heavy if the next is at most
    (rest of the weight) / (k - i). Only k + 1 weights are ordered in one place; the rest is one sum."""
    w = df.where(F.col(weight) > 0).select(F.col(weight).cast("double").alias("w"))
    sums = w.agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n"))
    top = w.orderBy(F.desc("w")).limit(spec.k)
    order = Window.orderBy(F.desc("w"))
    ranked = top.select("w", (F.row_number().over(order) - 1).alias("i"), F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), d(0.0)).alias("before"))
    both = ranked.crossJoin(F.broadcast(sums))  # at most k rows by one row
    cut = both.withColumn("tau", (F.col("total") - F.col("before")) / (d(spec.k) - F.col("i")))
    first = cut.where((F.col("n") > spec.k) & (F.col("w") <= F.col("tau"))).orderBy("i").limit(1).select("tau", F.col("i").cast("bigint").alias("heavy"))
    return sums.join(first, F.lit(True), "left").select(F.coalesce("tau", d(0.0)).alias("tau"), F.coalesce("heavy", "n").alias("heavy"), "n", "total")  # one row each


def varopt_sample(df: DataFrame, key: str, weight: str, spec: SampleSpec, seed: int = 0, hasher: Hasher = FAST) -> DataFrame:
    """df's columns, tau and adjusted weight max(w, tau): all heavy items, and the k - heavy lighter ones with the smallest
    priority u tau / w. If there are at most k items all are kept with their weights."""
    tau = varopt_tau(df, weight, spec)
    rows = df.where(F.col(key).isNotNull() & (F.col(weight) > 0)).crossJoin(F.broadcast(tau.select("tau")))  # one row
    w = F.col(weight).cast("double")
    priority = F.when(w > F.col("tau"), d(-1.0)).otherwise(hasher.unit(key, f"{seed}:") * F.col("tau") / w)
    kept = rows.withColumn("_p", priority).orderBy("_p", key).limit(spec.k)
    return kept.withColumn("adjusted", F.greatest(w, F.col("tau"))).drop("_p")


def subset_sum(sample: DataFrame, weight: str, predicate: Column) -> DataFrame:
    """estimate, lower, upper of the weight of all items that satisfy the predicate (1.96 standard deviations)."""
    w = F.col(weight).cast("double")
    variance = F.sum(F.when(w < F.col("adjusted"), F.col("adjusted") * (F.col("adjusted") - w)).otherwise(d(0.0)))
    chosen = sample.where(predicate).agg(F.coalesce(F.sum("adjusted"), d(0.0)).alias("estimate"), F.coalesce(F.sqrt(variance), d(0.0)).alias("_sd"))
    return chosen.select("estimate", F.greatest(d(0.0), F.col("estimate") - d(1.96) * F.col("_sd")).alias("lower"), (F.col("estimate") + d(1.96) * F.col("_sd")).alias("upper"))


def varopt_merge(a: DataFrame, b: DataFrame, key: str, spec: SampleSpec, seed: int = 1, hasher: Hasher = FAST) -> DataFrame:
    """A sample of two samples: their adjusted weights are sampled anew."""
    cols = [c for c in a.columns if c not in ("tau", "adjusted")]
    both = a.select(*cols, "adjusted").unionByName(b.select(*cols, "adjusted")).withColumnRenamed("adjusted", "_w")
    return varopt_sample(both, key, "_w", spec, seed, hasher).withColumnRenamed("_w", "weight_before")
