"""Queries of quantiles: exact answers, and whether the summary's answer meets its rank-error bound. The SQL counterpart computes the exact
answer on its own and expects true."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import ReqSpec, TDigestSpec
from ..operators import quantiles as u
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


def _ranked(rows: DataFrame, value: str, keys: list[str], asked: DataFrame, names: dict[str, tuple[float, float]]) -> DataFrame:
    """keys.., n and per question (column -> rank, tolerance) whether the share of values under (and up to) it brackets the rank."""
    joined = rows.join(F.broadcast(asked), keys) if keys else rows.crossJoin(F.broadcast(asked))  # one row per key, few keys
    checks = []
    for name, (rank, tolerance) in names.items():
        below, upto = F.avg((F.col(value) < F.col(name)).cast("double")), F.avg((F.col(value) <= F.col(name)).cast("double"))
        checks.append(((below - tolerance <= rank) & (upto + tolerance >= rank)).alias(f"{name}_ok"))
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *checks)


@query("select l_returnflag, count(*) as n, true as q0_ok, true as q1_ok, true as q2_ok from lineitem group by 1")
def kll_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    asked = u.kll_quantiles(u.kll_build(rows, "l_extendedprice", ["l_returnflag"]), [0.25, 0.5, 0.99], ["l_returnflag"])
    return _ranked(rows, "l_extendedprice", ["l_returnflag"], asked, {"q0": (0.25, 0.03), "q1": (0.5, 0.03), "q2": (0.99, 0.03)})


@query("select count(*) as n, true as q0_ok, true as q1_ok, true as q2_ok, min(l_extendedprice) as lowest, max(l_extendedprice) as highest from lineitem")
def kll_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    merged = u.kll_merge(u.kll_build(rows, "l_extendedprice", ["l_returnflag"]), [])
    asked = u.kll_quantiles(merged, [0.05, 0.5, 0.95, 0.0, 1.0], [])
    checked = _ranked(rows, "l_extendedprice", [], asked, {"q0": (0.05, 0.03), "q1": (0.5, 0.03), "q2": (0.95, 0.03)})
    return checked.crossJoin(asked.select(F.col("q3").alias("lowest"), F.col("q4").alias("highest")))  # one row each


_SPLITS = [1000.0, 20000.0, 40000.0, 60000.0, 80000.0]


@query("select round(avg((l_extendedprice <= 40000)::double), 4) as exact_cdf, true as cdf_ok, true as pmf_ok from lineitem")
def kll_cdf_pmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    ranks = u.kll_ranks(u.kll_build(rows, "l_extendedprice", []), _SPLITS, [])
    exact = rows.agg(*[F.avg((F.col("l_extendedprice") <= s).cast("double")).alias(f"e{i}") for i, s in enumerate(_SPLITS)])
    near = F.lit(True)
    for i in range(len(_SPLITS)):
        near = near & (F.abs(F.col("cdf")[i] - F.col(f"e{i}")) <= 0.03)
    total = F.abs(F.aggregate("pmf", F.lit(0.0), lambda a, x: a + x) - 1.0) < 1e-9
    return exact.crossJoin(ranks).select(F.round("e2", 4).alias("exact_cdf"), near.alias("cdf_ok"), total.alias("pmf_ok"))  # one row each


@query("select count(*) as n, true as p99_ok, true as p999_ok, true as p50_ok from lineitem")
def req_high_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    state = u.req_build(rows, "l_extendedprice", [], ReqSpec(12, "HRA"))
    asked = u.ask(state, [], u.Req.from_bytes, {"p99": lambda s: s.quantile(0.99), "p999": lambda s: s.quantile(0.999), "p50": lambda s: s.quantile(0.5)})
    return _ranked(rows, "l_extendedprice", [], asked, {"p99": (0.99, 0.003), "p999": (0.999, 0.0005), "p50": (0.5, 0.05)})


@query("select l_returnflag, count(*) as n, true as p01_ok, true as p001_ok from lineitem group by 1")
def req_low_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    state = u.req_build(rows, "l_extendedprice", ["l_returnflag"], ReqSpec(12, "LRA"))
    asked = u.ask(state, ["l_returnflag"], u.Req.from_bytes, {"p01": lambda s: s.quantile(0.01), "p001": lambda s: s.quantile(0.001)})
    return _ranked(rows, "l_extendedprice", ["l_returnflag"], asked, {"p01": (0.01, 0.003), "p001": (0.001, 0.0005)})


@query("select event_type, count(*) as n, true as median_ok, true as p95_ok, true as p99_ok from events group by 1")
def tdigest_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    state = u.tdigest_build(rows, "value", ["event_type"])
    asked = u.ask(state, ["event_type"], u.TDigest.from_bytes, {"median": lambda s: s.quantile(0.5), "p95": lambda s: s.quantile(0.95), "p99": lambda s: s.quantile(0.99)})
    return _ranked(rows, "value", ["event_type"], asked, {"median": (0.5, 0.02), "p95": (0.95, 0.01), "p99": (0.99, 0.005)})


@query("select round(avg(value), 4) as exact_mid_mean, true as trimmed_ok from (select value, ntile(20) over (order by value, event_id) as t from events) where t between 3 and 18")
def tdigest_trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the middle 80 %, exact by 20 equal parts of the ordered rows, and the digest's within 2 %."""
    rows = table(spark, sf_dir, "events")
    state = u.tdigest_build(rows, "value", [], TDigestSpec(200))
    asked = u.ask(state, [], u.TDigest.from_bytes, {"trimmed": lambda s: s.trimmed_mean(0.1, 0.9)})
    from pyspark.sql import Window

    parts = rows.select("value", F.ntile(20).over(Window.orderBy("value", "event_id")).alias("t"))
    exact = parts.where("t between 3 and 18").agg(F.avg("value").alias("exact"))
    both = exact.crossJoin(asked)  # one row each
    return both.select(F.round("exact", 4).alias("exact_mid_mean"), (F.abs(F.col("trimmed") - F.col("exact")) <= F.abs(F.col("exact")) * 0.02).alias("trimmed_ok"))


@query("select count(*) as n, true as q0_ok from events")
def native_percentile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    asked = rows.agg(F.percentile_approx("value", 0.9, 1000).alias("q0"))
    return _ranked(rows, "value", [], asked, {"q0": (0.9, 0.005)})





@query("select event_type, count(*) as n, min(value) as min, max(value) as max, true as small from events group by 1")
def tdigest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = u.statistics(u.tdigest_build(table(spark, sf_dir, "events"), "value", ["event_type"]), ["event_type"], u.TDigest.from_bytes)
    return stats.select("event_type", "n", "min", "max", (F.col("bytes") < 8000).alias("small"))
