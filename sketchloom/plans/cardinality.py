"""Queries of distinct counts with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import CpcSpec, HllSpec, HybridSpec, LinearSpec
from ..operators import cardinality
from ..operators.cardinality import HLLPP_THRESHOLDS, ICON_11
from ..sources.tables import table
from . import sql as q

c = q.Portable(cardinality)
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


def r6(col: str) -> F.Column:
    return F.round(col, 4).alias(col)


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_custkey")


MONTHS = "(select strftime(o_orderdate, '%Y-%m') as month, o_custkey from orders)"
YEARS = "(select strftime(o_orderdate, '%Y') as year, o_custkey from orders)"


@query(
    f"""select month, round(estimate, 4) as estimate, exact, round(abs(estimate - exact) / exact, 4) as relative_error
    from (select month, {q.hll_estimate(12)} as estimate from ({q.hll_registers(MONTHS, "o_custkey", "month, ", 12)}) group by month)
    join (select month, count(distinct o_custkey) as exact from {MONTHS} group by month) using (month)"""
)
def hll_distinct_customers_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _months(spark, sf_dir)
    est = c.hll_estimate(c.hll_build(rows, "o_custkey", ["month"]), ["month"])
    both = est.join(c.exact_distinct(rows, "o_custkey", ["month"]), "month")
    error = F.round(F.abs(F.col("estimate") - F.col("exact")) / F.col("exact"), 4).alias("relative_error")
    return both.select("month", r6("estimate"), "exact", error)


@query(f"""select year, round({q.hll_estimate(12)}, 4) as estimate, true as equals_direct from ({q.hll_registers(YEARS, "o_custkey", "year, ", 12)}) group by year""")
def hll_rollup_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years merged from months' states, compared with years built directly."""
    rows = _months(spark, sf_dir)
    months = c.hll_build(rows, "o_custkey", ["month"])
    rolled = c.hll_combine(months.withColumn("year", F.substring("month", 1, 4)), ["year"])
    direct = c.hll_build(rows.withColumn("year", F.substring("month", 1, 4)), "o_custkey", ["year"])
    pairs = c.hll_estimate(rolled, ["year"]).join(c.hll_estimate(direct, ["year"], name="direct"), "year")
    return pairs.select("year", r6("estimate"), (F.col("estimate") == F.col("direct")).alias("equals_direct"))


@query(f"""select round({q.hll_estimate(12)}, 4) as estimate from ({q.hll_registers("lineitem", "l_partkey", "", 12, "l_returnflag in ('A', 'R')")})""")
def hll_merge_returnflags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    parts = [c.hll_build(rows.where(F.col("l_returnflag") == flag), "l_partkey", []) for flag in ("A", "R")]
    return c.hll_estimate(c.hll_merge(*parts, []), []).select(r6("estimate"))


@query(f"""select round({q.hll_estimate(10)}, 4) as estimate from ({q.hll_registers("lineitem", "l_orderkey", "", 10)})""")
def hll_fold_to_smaller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A p = 12 state folded to p = 10 equals the one built there."""
    state = c.hll_build(table(spark, sf_dir, "lineitem"), "l_orderkey", [], HllSpec(12))
    return c.hll_estimate(c.hll_fold(state, [], HllSpec(12), HllSpec(10)), [], HllSpec(10)).select(r6("estimate"))


@query(f"""select round({q.hll_estimate(9)}, 4) as estimate from ({q.hll_registers("lineitem", "l_partkey", "", 9, "l_returnflag in ('A', 'N')")})""")
def hll_union_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, a, b = table(spark, sf_dir, "lineitem"), HllSpec(12), HllSpec(9)
    left = c.hll_build(rows.where("l_returnflag = 'A'"), "l_partkey", [], a)
    right = c.hll_build(rows.where("l_returnflag = 'N'"), "l_partkey", [], b)
    union, spec = c.hll_union(left, a, right, b, [], HllSpec(11))
    return c.hll_estimate(union, [], spec).select(r6("estimate"))


@query(f"""select p_brand, round({q.hll_estimate(10, HLLPP_THRESHOLDS[6])}, 4) as estimate from ({q.hll_registers("part", "p_partkey", "p_brand, ", 10)}) group by p_brand""")
def hllpp_small_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = HllSpec(10)
    return c.hllpp_estimate(c.hll_build(table(spark, sf_dir, "part"), "p_partkey", ["p_brand"], spec), ["p_brand"], spec).select("p_brand", r6("estimate"))


@query(
    f"""select event_type, mode, slots, round(case when mode = 'HLL' then est else slots::double end, 4) as estimate from
    (select event_type, {q.hll_estimate(10)} as est, count(*) as slots, case when count(*) < 8 then 'LIST' when count(*) * 4 <= 192 then 'SET' else 'HLL' end as mode
     from ({q.hll_registers("events", "user_id", "event_type, ", 10)}) group by 1)"""
)
def hll_mode_by_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = HllSpec(10)
    state = c.hll_build(table(spark, sf_dir, "events"), "user_id", ["event_type"], spec)
    return c.hll_modes(state, ["event_type"], spec).select("event_type", "mode", "slots", r6("estimate"))


@query(f"""select i.idx::int as idx, coalesce(rank, 0)::int as rank from range(64) i(idx) left join ({q.hll_registers("orders", "o_custkey", "", 6)}) r on r.idx = i.idx""")
def hll_dense_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = HllSpec(6)
    return c.dense_registers(c.hll_build(table(spark, sf_dir, "orders"), "o_custkey", [], spec), [], spec)


@query(f"""select p_brand, count(*) as entries, count(*) * 33 <= {0.7 * 4096}::double as is_sparse from ({q.hll_registers("part", "p_partkey", "p_brand, ", 12)}) group by p_brand""")
def hll_adaptive_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = HllSpec(12)
    return c.hll_density(c.hll_build(table(spark, sf_dir, "part"), "p_partkey", ["p_brand"], spec), ["p_brand"], spec)


def _cpc_rows(tab: str, item: str, lg_k: int, where: str = "true") -> str:
    return f"""select ({q.h60(item)}) & {(1 << lg_k) - 1} as r, bit_or((1::bigint << (60 - {q.bits(q.h60(item, "cpc:"))}))::bigint) as b from {tab} where {where} group by 1"""


def _icon(k: int) -> str:
    poly = f"{ICON_11[-1]!r}::double"
    for a in reversed(ICON_11[:-1]):
        poly = f"(({poly}) * x + {a!r}::double)"
    return f"""(case when c < 2 then c when c > {5.7 * k}::double then greatest(c, {0.7940236163830469 * k!r}::double * pow(2::double, c / {k}::double))
      else greatest(c, c * {poly} * (1 + pow(c / {k}::double, 3) / 66.774757::double)) end)"""


def _cpc(rows: str, lg_k: int = 11) -> str:
    k = 1 << lg_k
    return f"""select coupons, case when coupons = 0 then 'Empty' when coupons * 32 < {3 * k} then 'Sparse' when coupons * 2 < {k} then 'Hybrid' when coupons * 8 < {27 * k} then 'Pinned' else 'Sliding' end as flavor,
      round({_icon(k)}, 4) as estimate from (select sum(bit_count(b))::bigint as coupons, sum(bit_count(b))::double as c, sum(bit_count(b))::double / {2 * k}::double as x from ({rows}))"""


@query(_cpc(_cpc_rows("lineitem", "l_orderkey", 11)))
def cpc_icon_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.cpc_estimate(c.cpc_build(table(spark, sf_dir, "lineitem"), "l_orderkey", []), []).select("coupons", "flavor", r6("estimate"))


@query(_cpc(_cpc_rows("lineitem", "l_orderkey", 11)))
def cpc_union_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the rows, one built at lg_k = 12, united at 11."""
    rows, a, b = table(spark, sf_dir, "lineitem"), CpcSpec(12), CpcSpec(11)
    halves = c.cpc_build(rows.where("l_linenumber <= 3"), "l_orderkey", [], a), c.cpc_build(rows.where("l_linenumber > 3"), "l_orderkey", [], b)
    union, spec = c.cpc_union(halves[0], a, halves[1], b, [])
    return c.cpc_estimate(union, [], spec).select("coupons", "flavor", r6("estimate"))


def _linear(m: int, keys: str, tab: str, item: str) -> str:
    used = "count(*)::double"
    est = f"(case when {used} >= {m} then {1.5 * m}::double else -{m}::double * ln(({m}::double - {used}) / {m}::double) end)"
    return f"""select {keys} {m}::bigint as num_bits, count(*) as bits_set, round({used} / {m}::double, 4) as fill_ratio, round({est}, 4) as estimate,
      {used} / {m}::double > 0.3::double or {est} > {0.1 * m}::double as should_transition from (select distinct {keys} ({q.h60(item)}) % {m} as b from {tab}) group by all"""


@query(_linear(4096, "event_type,", "events", "user_id"))
def linear_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = LinearSpec(4096)
    state = c.linear_build(table(spark, sf_dir, "events"), "user_id", ["event_type"], spec)
    return c.linear_estimate(state, ["event_type"], spec).select("event_type", "num_bits", "bits_set", r6("fill_ratio"), r6("estimate"), "should_transition")


@query(_linear(8192, "", "lineitem", "l_partkey"))
def linear_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec, rows = LinearSpec(8192), table(spark, sf_dir, "lineitem")
    halves = [c.linear_build(rows.where(w), "l_partkey", [], spec) for w in ("l_linenumber <= 3", "l_linenumber > 3")]
    return c.linear_estimate(c.linear_merge(*halves), [], spec).select("num_bits", "bits_set", r6("fill_ratio"), r6("estimate"), "should_transition")


HYBRID = HybridSpec.for_range(2000)
_M = HYBRID.linear.m
_STAY = f"used / {_M}::double <= 0.3::double and lin <= {0.1 * _M}::double"


@query(
    f"""select month, case when {_STAY} then 'Linear Counter' else 'HyperLogLog' end as mode, round(case when {_STAY} then lin else est end, 4) as estimate from
    (select month, used, case when used >= {_M} then {1.5 * _M}::double else -{_M}::double * ln(({_M}::double - used) / {_M}::double) end as lin
     from (select month, count(distinct ({q.h60("o_custkey")}) % {_M})::double as used from {MONTHS} group by 1))
    join (select month, {q.hll_estimate(HYBRID.hll.p)} as est from ({q.hll_registers(MONTHS, "o_custkey", "month, ", HYBRID.hll.p)}) group by 1) using (month)"""
)
def hybrid_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.hybrid_estimate(_months(spark, sf_dir), "o_custkey", ["month"], HYBRID).select("month", "mode", r6("estimate"))


@query("select l_returnflag, count(distinct l_orderkey) as exact, true as within_bound from lineitem group by 1")
def native_hll_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own HLL aggregate at lg_k = 12 lies within 5 % of the exact count."""
    rows = table(spark, sf_dir, "lineitem")
    both = c.native_hll(rows, "l_orderkey", ["l_returnflag"]).join(c.exact_distinct(rows, "l_orderkey", ["l_returnflag"]), "l_returnflag")
    within = F.abs(F.hll_sketch_estimate("sketch") - F.col("exact")) <= 0.05 * F.col("exact")
    return both.select("l_returnflag", "exact", within.alias("within_bound"))


@query("select count(distinct o_custkey) as exact, true as within_bound from orders")
def native_hll_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly summaries of Spark's aggregate united into one."""
    rows = _months(spark, sf_dir)
    union = c.native_hll(rows, "o_custkey", ["month"]).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("est"))
    both = union.crossJoin(c.exact_distinct(rows, "o_custkey", []))  # one row each
    return both.select("exact", (F.abs(F.col("est") - F.col("exact")) <= 0.05 * F.col("exact")).alias("within_bound"))


@query("select approx.exact as exact, true as within_bound from (select count(distinct l_partkey) as exact from lineitem) approx")
def native_hllpp_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    both = rows.agg(F.approx_count_distinct("l_partkey", 0.02).alias("est"), F.count_distinct("l_partkey").alias("exact"))
    return both.select("exact", (F.abs(F.col("est") - F.col("exact")) <= 0.08 * F.col("exact")).alias("within_bound"))


@query(f"""select idx, rank, count(*) as registers from (select idx % 4 as idx, rank from ({q.hll_registers("orders", "o_custkey", "", 8)})) group by all""")
def hll_register_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = c.hll_build(table(spark, sf_dir, "orders"), "o_custkey", [], HllSpec(8))
    return state.groupBy((F.col("idx") % 4).cast("bigint").alias("idx"), F.col("rank").cast("bigint").alias("rank")).agg(F.count(F.lit(1)).alias("registers"))


@query(f"""select sum(bit_count(b))::bigint as coupons, count(*) as rows_used, max(bit_count(b))::bigint as most from ({_cpc_rows("orders", "o_custkey", 10)})""")
def cpc_bit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = c.cpc_build(table(spark, sf_dir, "orders"), "o_custkey", [], CpcSpec(10))
    n = F.bit_count("bits").cast("bigint")
    return state.agg(F.sum(n).alias("coupons"), F.count(F.lit(1)).alias("rows_used"), F.max(n).alias("most"))
