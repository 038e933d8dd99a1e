"""Queries of samples with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import SampleSpec
from ..operators import sampling
from ..sources.tables import table
from . import sql as q

s = q.Portable(sampling)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
SPEC = SampleSpec(200)


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


@query(f"select event_id, event_type, {q.h60('event_id', '7:')} as sample_hash from events order by sample_hash, event_id limit 200")
def reservoir_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.uniform_sample(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", SPEC, seed=7)


@query(f"select event_id, {q.h60('event_id', '7:')} as sample_hash from events order by sample_hash, event_id limit 200")
def reservoir_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two parts merge into the sample of the whole."""
    rows = table(spark, sf_dir, "events").select("event_id")
    parts = [s.uniform_sample(rows.where(w), "event_id", SPEC, seed=7) for w in ("event_id % 3 = 0", "event_id % 3 <> 0")]
    return s.merge_uniform(*parts, "event_id", SPEC)


@query(
    f"""select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by {q.h60("event_id", "3:")}, event_id) as r from events) where r <= 50"""
)
def reservoir_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id")
    return s.uniform_sample_by(rows, ["event_type"], "event_id", SampleSpec(50), seed=3).drop("sample_hash")


@query(f"select o_orderkey, o_totalprice from orders where o_totalprice > 0 order by ln({q.unit('o_orderkey', '5:')}) / o_totalprice desc, o_orderkey limit 200")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return s.weighted_sample(rows, "o_orderkey", "o_totalprice", SPEC, seed=5).drop("sample_key")


#: Skewed weights: the fourth power of the price makes some orders heavy.
_W = "(select o_orderkey, o_orderstatus, pow(o_totalprice / 1000.0::double, 4) as w from orders)"
_TAU = f"""r as (select w, row_number() over (order by w desc) - 1 as i, coalesce(sum(w) over (order by w desc rows between unbounded preceding and 1 preceding), 0) as b from {_W}),
  t as (select (select sum(w) from {_W}) as total, (select count(*) from {_W}) as n),
  tau as (select i as heavy, (t.total - b) / (200 - i) as tau from r, t where i < 200 and w <= (t.total - b) / (200 - i) order by i limit 1)"""


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.pow(F.col("o_totalprice") / F.lit(1000.0), F.lit(4.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", w.alias("w"))


@query(f"with {_TAU} select round(tau / 1000000, 4) as tau_millions, heavy, n from tau, t")
def varopt_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.varopt_tau(_skewed(spark, sf_dir), "w", SPEC).select(F.round(F.col("tau") / F.lit(1e6), 4).alias("tau_millions"), "heavy", "n")


@query(
    f"""with {_TAU}, k as (select w, o_orderstatus, greatest(w, tau) as a from {_W}, tau order by case when w > tau then -1 else {q.unit("o_orderkey", "9:")} * tau / w end, o_orderkey limit 200)
    select count(*) as kept, round(sum(case when o_orderstatus = 'F' then a else 0 end) / 1000000, 2) as estimate_f_millions from k"""
)
def varopt_subset_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = s.varopt_sample(_skewed(spark, sf_dir), "o_orderkey", "w", SPEC, seed=9)
    chosen = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("adjusted")).otherwise(F.lit(0.0)))
    return sample.agg(F.count(F.lit(1)).alias("kept"), F.round(chosen / F.lit(1e6), 2).alias("estimate_f_millions"))


@query(f"select round(sum(w) filter (o_orderstatus = 'F') / 1000000, 2) as exact_f_millions, true as within_three_sd from {_W}")
def varopt_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _skewed(spark, sf_dir)
    sample = s.varopt_sample(rows, "o_orderkey", "w", SampleSpec(1000), seed=9)
    est = s.subset_sum(sample, "w", F.col("o_orderstatus") == "F")
    exact = rows.where("o_orderstatus = 'F'").agg(F.sum("w").alias("exact"))
    sd = (F.col("upper") - F.col("estimate")) / F.lit(1.96)
    both = exact.crossJoin(est)  # one row each
    return both.select(F.round(F.col("exact") / F.lit(1e6), 2).alias("exact_f_millions"), (F.abs(F.col("exact") - F.col("estimate")) <= sd * 3).alias("within_three_sd"))


@query(f"select o_orderkey, o_totalprice from orders where o_totalprice > 0 order by ln({q.unit('o_orderkey', '5:')}) / o_totalprice desc, o_orderkey limit 200")
def weighted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted samples of two parts merge into the sample of the whole."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    parts = [s.weighted_sample(rows.where(w), "o_orderkey", "o_totalprice", SPEC, seed=5) for w in ("o_orderkey % 4 = 0", "o_orderkey % 4 <> 0")]
    return s.merge_weighted(*parts, "o_orderkey", SPEC).drop("sample_key")


@query(f"select round(sum(w) / 1000000, 0) as total_millions, true as total_kept from {_W}")
def varopt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adjusted weights of a merged sample add up to the total of both parts."""
    rows = _skewed(spark, sf_dir)
    parts = [s.varopt_sample(rows.where(w), "o_orderkey", "w", SampleSpec(400), seed=2) for w in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1")]
    merged = s.varopt_merge(*[p.drop("w") for p in parts], "o_orderkey", SampleSpec(400))
    both = merged.agg(F.sum("adjusted").alias("a")).crossJoin(rows.agg(F.sum("w").alias("t")))  # one row each
    return both.select(F.round(F.col("t") / F.lit(1e6), 0).alias("total_millions"), (F.abs(F.col("a") - F.col("t")) <= 1e-6 * F.col("t")).alias("total_kept"))


@query("select count(*) as items_seen, least(count(*), 200) as sample_size, 200::bigint as capacity, count(*) >= 200 as is_full, round(sum(o_totalprice), 2) as total_weight from orders where o_totalprice > 0")
def weighted_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.sample_statistics(table(spark, sf_dir, "orders"), "o_orderkey", SPEC, "o_totalprice")
    return out.withColumn("total_weight", F.round("total_weight", 2))
