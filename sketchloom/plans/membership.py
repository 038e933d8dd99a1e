"""Queries of Bloom filters with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import BloomSpec
from ..operators import membership
from ..sources.tables import table
from . import sql as q
from .cardinality import r6

b = q.Portable(membership)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
SPEC = BloomSpec(2000, 0.01)


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


def _positions(item: str, tab: str, where: str = "true", keep: str = "") -> str:
    return f"""select distinct {keep} ({q.h32(item, 0)} + i * {q.h32(item, 1)}) % {SPEC.m} as pos from {tab}, range({SPEC.k}) r(i) where {where}"""


_MEMBERS = "o_orderstatus = 'F'"


@query(
    f"""select {SPEC.m}::bigint as num_bits, {SPEC.k}::bigint as num_hash_functions, count(*) as bits_set, round(count(*)::double / {SPEC.m}::double, 4) as fill_ratio,
    round(pow(count(*)::double / {SPEC.m}::double, {SPEC.k}::double), 6) as fpp, round(pow(1 - exp(-{SPEC.k}::double * (count(*)::double / {SPEC.m}::double)), {SPEC.k}::double), 6) as fpp_exp
    from ({_positions("o_custkey", "orders", _MEMBERS)})"""
)
def bloom_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = b.bloom_build(table(spark, sf_dir, "orders").where(_MEMBERS), "o_custkey", [], SPEC)
    fpp = [F.round(x, 6).alias(x) for x in ("fpp", "fpp_exp")]
    return b.bloom_statistics(state, [], SPEC).select("num_bits", "num_hash_functions", "bits_set", r6("fill_ratio"), *fpp)


_HITS = lambda where: f"""select c_custkey from (select distinct c_custkey, ({q.h32("c_custkey", 0)} + i * {q.h32("c_custkey", 1)}) % {SPEC.m} as pos from customer, range({SPEC.k}) r(i)) p
  left join (select pos, 1 as one from ({_positions("o_custkey", "orders", where)})) s using (pos) group by c_custkey having count(one) = count(*)"""  # noqa: E731


@query(f"select c_custkey, c_mktsegment from customer where c_custkey in ({_HITS(_MEMBERS)})")
def bloom_semijoin_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = b.bloom_build(table(spark, sf_dir, "orders").where(_MEMBERS), "o_custkey", [], SPEC)
    return b.bloom_semi_join(table(spark, sf_dir, "customer"), "c_custkey", state, SPEC).select("c_custkey", "c_mktsegment")


@query(
    f"""with hits as ({_HITS("o_custkey % 2 = 0")}), m as (select distinct o_custkey from orders where o_custkey % 2 = 0)
    select (select count(*) from hits) as hits, (select count(*) from customer where c_custkey in (select o_custkey from m)) as members,
    (select count(*) from m where o_custkey not in (select c_custkey from hits) and o_custkey in (select c_custkey from customer)) as missed"""
)
def bloom_observed_fpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, members and missed members (never any) among all customers."""
    members = table(spark, sf_dir, "orders").where("o_custkey % 2 = 0")
    customers = table(spark, sf_dir, "customer")
    asked = b.bloom_contains(b.bloom_build(members, "o_custkey", [], SPEC), customers, "c_custkey", SPEC)
    true = members.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("in", F.lit(True))
    both = asked.join(true, "c_custkey", "left")
    return both.agg(F.count_if("hit").alias("hits"), F.count("in").alias("members"), F.count_if(F.col("in") & ~F.col("hit")).alias("missed"))


@query(f"select count(*) as bits_set from ({_positions('l_partkey', 'lineitem')})")
def bloom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    halves = [b.bloom_build(rows.where(w), "l_partkey", [], SPEC) for w in ("l_linenumber <= 3", "l_linenumber > 3")]
    return b.bloom_merge(*halves).agg(F.count(F.lit(1)).alias("bits_set"))


_COUNT = f"""select pos, count(*) as n from (select ({q.h32("user_id", 0)} + i * {q.h32("user_id", 1)}) % {SPEC.m} as pos from {{tab}}, range({SPEC.k}) r(i)) group by 1"""


@query(
    f"""with a as ({_COUNT.format(tab="(select distinct user_id, event_type from events)")}), g as (select distinct user_id from events where user_id % 3 = 0), t as ({_COUNT.format(tab="g")}),
    s as (select pos, a.n - coalesce(t.n, 0) as n from a left join t using (pos)) select count(*) as positions, sum(n)::bigint as total from s where n > 0"""
)
def counting_bloom_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by event type are added, every third user is removed once."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type").distinct()
    state = b.counting_build(rows, "user_id", [], SPEC)
    left = b.counting_remove(state, rows.where("user_id % 3 = 0"), "user_id", SPEC)
    return left.agg(F.count(F.lit(1)).alias("positions"), F.sum("n").alias("total"))
