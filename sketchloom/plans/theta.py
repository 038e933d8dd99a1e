"""Queries of theta, tuple and array-of-doubles summaries with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import BITS
from ..functions.spec import AodSpec, ThetaSpec
from ..operators import cardinality
from ..operators import theta
from ..sources.tables import table
from . import sql as q
from .cardinality import r6

t = q.Portable(theta)
c = q.Portable(cardinality)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
SPEC = ThetaSpec(1024)
FULL = 1 << BITS


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


def _flags(spark: SparkSession, sf_dir: str, item: str = "l_partkey") -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    return tuple(t.theta_build(rows.where(F.col("l_returnflag") == f), item, [], SPEC) for f in ("A", "R"))


A, R = (q.theta_state("lineitem", "l_partkey", 1024, f"l_returnflag = '{f}'") for f in ("A", "R"))
_TOP = "(select least((select min(theta) from a), (select min(theta) from b)))"


@query(f"select count(*) as retained, min(theta) as theta, round({q.theta_estimate()}, 4) as estimate from ({q.theta_state('lineitem', 'l_orderkey', 1024)})")
def theta_distinct_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.theta_estimate(t.theta_build(table(spark, sf_dir, "lineitem"), "l_orderkey", [], SPEC), []).select("retained", "theta", r6("estimate"))


@query(
    f"""with h as (select distinct l_returnflag, {q.h60("l_orderkey")} as h from lineitem),
    n as (select *, row_number() over (partition by l_returnflag order by h) as i from h),
    s as (select l_returnflag, h, coalesce(max(case when i = 1025 then h end) over (partition by l_returnflag), {FULL}) as theta, i from n)
    select l_returnflag, count(*) as retained, min(theta) as theta, round({q.theta_estimate()}, 4) as estimate from s where i <= 1024 group by 1"""
)
def theta_orders_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = t.theta_build(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag"], SPEC)
    return t.theta_estimate(state, ["l_returnflag"]).select("l_returnflag", "retained", "theta", r6("estimate"))


@query(
    f"""with a as ({A}), b as ({R}), u as (select distinct h from (select h from a union all select h from b) where h < {_TOP}),
    n as (select h, row_number() over (order by h) as i from u), top as (select least({_TOP}, coalesce((select h from n where i = 1025), {FULL})) as theta)
    select count(*) as retained, round({q.theta_estimate("min(theta)")}, 4) as estimate from n, top where i <= 1024 and h < theta"""
)
def theta_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.theta_estimate(t.theta_union(*_flags(spark, sf_dir), [], SPEC), []).select("retained", r6("estimate"))


@query(
    f"""with a as ({A}), b as ({R}) select count(*) as retained, round({q.theta_estimate("min(top)")}, 4) as estimate
    from (select h, {_TOP} as top from a where h in (select h from b)) where h < top"""
)
def theta_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.theta_estimate(t.theta_intersect(*_flags(spark, sf_dir), []), []).select("retained", r6("estimate"))


@query(
    f"""with a as ({A}), b as ({R}) select count(*) as retained, round({q.theta_estimate("min(top)")}, 4) as estimate
    from (select h, {_TOP} as top from a where h not in (select h from b)) where h < top"""
)
def theta_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.theta_estimate(t.theta_difference(*_flags(spark, sf_dir), []), []).select("retained", r6("estimate"))


@query(
    f"""with a as ({A}), b as ({R}), u as (select distinct h from (select h from a union all select h from b) where h < {_TOP}),
    n as (select h, row_number() over (order by h) as i from u) select round(count(*) filter (h in (select h from a) and h in (select h from b))::double / count(*)::double, 4) as jaccard from n where i <= 1024"""
)
def theta_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.theta_jaccard(*_flags(spark, sf_dir), SPEC).select(r6("jaccard"))


@query("select count(distinct l_orderkey) as exact, true as within_bound from lineitem")
def native_theta_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    both = t.native_theta(rows, "l_orderkey", []).crossJoin(c.exact_distinct(rows, "l_orderkey", []))  # one row each
    return both.select("exact", (F.abs(F.theta_sketch_estimate("sketch") - F.col("exact")) <= 0.06 * F.col("exact")).alias("within_bound"))


SUMS = {"revenue": ("sum", "cents"), "lines": ("count", "l_partkey")}
_TUPLE = f"""n as (select h, revenue, lines, row_number() over (order by h) as i from
  (select {q.h60("l_orderkey")} as h, sum(round(l_extendedprice * 100)::bigint)::bigint as revenue, count(*) as lines from lineitem where {{where}} group by 1))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))


@query(
    f"""with {_TUPLE.format(where="true")}, top as (select coalesce((select h from n where i = 1025), {FULL}) as theta)
    select count(*) as retained, round({q.theta_estimate()}, 4) as estimate, round(sum(revenue)::double / (min(theta)::double / {FULL}::double), 0) as total_revenue, round(sum(lines)::double / (min(theta)::double / {FULL}::double), 4) as total_lines
    from n, top where i <= 1024"""
)
def tuple_revenue_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = t.tuple_build(_lines(spark, sf_dir), "l_orderkey", SUMS, [], SPEC)
    return t.tuple_estimate(state, [], ["revenue", "lines"]).select("retained", r6("estimate"), F.round("total_revenue", 0).alias("total_revenue"), r6("total_lines"))


def _tuple_sides(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return tuple(t.tuple_build(rows.where(w), "l_orderkey", SUMS, [], SPEC) for w in ("l_returnflag = 'A'", "l_returnflag = 'N'"))


_SIDE = lambda name, flag: _TUPLE.format(where=f"l_returnflag = '{flag}'").replace("n as", f"{name} as", 1)
_SIDES = f"{_SIDE('x', 'A')}, {_SIDE('y', 'N')}, top as (select least(coalesce((select h from x where i = 1025), {FULL}), coalesce((select h from y where i = 1025), {FULL})) as theta)"


@query(f"""with {_SIDES} select x.h as h, x.revenue + y.revenue as revenue, x.lines + y.lines as lines from x join y using (h), top where x.i <= 1024 and y.i <= 1024 and h < theta""")
def tuple_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _tuple_sides(spark, sf_dir)
    return t.tuple_intersect(a, b, {"revenue": "sum", "lines": "sum"}, []).select("h", "revenue", "lines")


@query(f"""with {_SIDES} select h, revenue, lines from x, top where i <= 1024 and h < theta and h not in (select h from y where i <= 1024)""")
def tuple_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _tuple_sides(spark, sf_dir)
    return t.tuple_difference(a, b, []).select("h", "revenue", "lines")


@query(
    f"""with {_SIDES}, u as (select h, sum(revenue)::bigint as revenue, sum(lines)::bigint as lines from (select h, revenue, lines from x where i <= 1024 union all select h, revenue, lines from y where i <= 1024), top where h < theta group by 1),
    n as (select *, row_number() over (order by h) as j from u) select h, revenue, lines from n where j <= 1024"""
)
def tuple_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _tuple_sides(spark, sf_dir)
    return t.tuple_union(a, b, {"revenue": "sum", "lines": "sum"}, [], SPEC).select("h", "revenue", "lines")


AOD = AodSpec(512, 2)
KEEP = AOD.capacity * 3 // 4
_AOD = f"""n as (select h, v, e, row_number() over (order by h) as i, count(*) over () as c from
  (select {q.h60("o_custkey")} as h, max_by(o_totalprice, o_orderkey) as v, max(o_orderkey)::double as e from orders where {{where}} group by 1)),
  top as (select case when max(c) > {AOD.capacity} then max(case when i = {KEEP + 1} then h end) else {FULL} end as theta from n)"""
_PART = f"(min(theta)::double / {FULL}::double)"


def _aod(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    rows = table(spark, sf_dir, "orders").where(where).withColumn("key_value", F.col("o_orderkey").cast("double"))
    return t.aod_build(rows, "o_custkey", ["o_totalprice", "key_value"], "o_orderkey", [], AOD)


@query(
    f"""with {_AOD.format(where="true")} select count(*) as entries, round({_PART}, 6) as theta, round(count(*) / {_PART}, 4) as estimate,
    round(greatest(0, count(*) / {_PART} - 1.96 * sqrt(count(*) / {_PART} * (1 - {_PART}) / {_PART})), 4) as lower, round(count(*) / {_PART} + 1.96 * sqrt(count(*) / {_PART} * (1 - {_PART}) / {_PART}), 4) as upper,
    round(sum(v) / {_PART}, 0) as sum_price, round(sum(v) / count(*), 2) as mean_price, round(sum(e) / count(*), 4) as mean_key from n, top where h < theta"""
)
def aod_last_order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = t.aod_estimate(_aod(spark, sf_dir), [], AOD)
    return out.select(
        "entries", F.round("theta", 6).alias("theta"), r6("estimate"), r6("lower"), r6("upper"), F.round(F.col("sums")[0], 0).alias("sum_price"),
        F.round(F.col("means")[0], 2).alias("mean_price"), F.round(F.col("means")[1], 4).alias("mean_key"),
    )


@query(
    f"""with {_AOD.format(where="o_orderstatus = 'F'").replace("n as", "x as", 1).replace("from n", "from x").replace("top as", "tx as")},
    {_AOD.format(where="o_orderstatus <> 'F'").replace("n as", "y as", 1).replace("from n", "from y").replace("top as", "ty as")},
    m as (select least((select theta from tx), (select theta from ty)) as theta),
    u as (select h, max_by(v, side) as v from (select h, v, 0 as side from x, tx where h < tx.theta union all select h, v, 1 from y, ty where h < ty.theta), m where h < m.theta group by 1),
    r as (select *, row_number() over (order by h) as i, count(*) over () as c from u)
    select h, v as price from r where c <= {AOD.capacity} or i <= {KEEP}"""
)
def aod_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _aod(spark, sf_dir, "o_orderstatus = 'F'"), _aod(spark, sf_dir, "o_orderstatus <> 'F'")
    return t.aod_union(a, b, [], AOD).select("h", F.col("values")[0].alias("price"))


@query(
    """select (select count(*) from (select l_partkey from lineitem where l_returnflag = 'A' intersect select l_partkey from lineitem where l_returnflag = 'R')) as both_flags,
    (select count(*) from (select l_partkey from lineitem where l_returnflag = 'A' except select l_partkey from lineitem where l_returnflag = 'R')) as only_first, true as within_bound"""
)
def native_theta_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and difference of Spark's own summaries against exact set operations; the error is bounded by the union's size."""
    rows = table(spark, sf_dir, "lineitem")
    sides = [rows.where(F.col("l_returnflag") == f) for f in ("A", "R")]
    pair = t.native_theta(sides[0], "l_partkey", []).withColumnRenamed("sketch", "a").crossJoin(t.native_theta(sides[1], "l_partkey", []).withColumnRenamed("sketch", "b"))  # one row each
    est = pair.select(
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("i"), F.theta_sketch_estimate(F.theta_difference("a", "b")).alias("d"), F.theta_sketch_estimate(F.theta_union("a", "b")).alias("u")
    )
    first, second = (s.select("l_partkey").distinct() for s in sides)
    counts = first.join(second.withColumn("in", F.lit(1)), "l_partkey", "left").agg(F.count("in").alias("both_flags"), (F.count(F.lit(1)) - F.count("in")).alias("only_first"))
    near = (F.abs(F.col("i") - F.col("both_flags")) <= 0.1 * F.col("u")) & (F.abs(F.col("d") - F.col("only_first")) <= 0.1 * F.col("u"))
    return counts.crossJoin(est).select("both_flags", "only_first", near.alias("within_bound"))  # one row each
