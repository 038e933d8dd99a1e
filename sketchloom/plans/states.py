"""Queries of stored states: each family is built in parts, written as bytes with the checked header, read back and merged; statistics and
sizes of states; merges of any number of states; parameters made from error bounds. The SQL counterpart computes the whole directly."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import BITS, FAST, MURMUR3
from ..functions.register import register
from ..functions.spec import AodSpec, BloomSpec, CpcSpec, FrequentSpec, HllSpec, HybridSpec, KllSpec, LinearSpec, MatrixSpec, ReqSpec, SampleSpec, TDigestSpec, ThetaSpec
from ..operators import cardinality, frequency, membership, quantiles, sampling, sequential, theta
from ..sources import codec
from ..sources.shared import shared_dir
from ..sources.tables import delimited, table
from . import cardinality as cq
from . import frequency as fq
from . import membership as mq
from . import sampling as sq
from . import sql as q
from . import theta as tq
from .cardinality import r6

c, t, f, b, s = (q.Portable(m) for m in (cardinality, theta, frequency, membership, sampling))
QUERIES: dict = {}
ORACLE_SQL: dict = {}
HALVES = ("l_linenumber <= 3", "l_linenumber > 3")


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, oracle
        return fn

    return add


def stored(state: DataFrame, keys: list[str], family: str, columns: str | None = None, **parameters) -> DataFrame:
    """The state after a round trip through bytes."""
    return codec.from_bytes(codec.to_bytes(state, keys, family, parameters), keys, family, parameters, columns)


def _line_halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    rows = table(spark, sf_dir, "lineitem")
    return [rows.where(w) for w in HALVES]


# -- bytes of every family ------------------------------------------------------------------------------------------------


@query(f"""select month, round({q.hll_estimate(12)}, 4) as estimate from ({q.hll_registers(cq.MONTHS, "o_custkey", "month, ", 12)}) group by month""")
def bytes_hll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cq._months(spark, sf_dir)
    parts = [stored(c.hll_build(rows.where(w), "o_custkey", ["month"]), ["month"], "hll", p=12) for w in ("o_custkey % 2 = 0", "o_custkey % 2 = 1")]
    return c.hll_estimate(c.hll_merge(*parts, ["month"]), ["month"]).select("month", r6("estimate"))


@query(cq.ORACLE_SQL["cpc_icon_orders"])
def bytes_cpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stored(c.cpc_build(x, "l_orderkey", []), [], "cpc", lg_k=11) for x in _line_halves(spark, sf_dir)]
    return c.cpc_estimate(c.cpc_combine(parts[0].unionByName(parts[1]), []), []).select("coupons", "flavor", r6("estimate"))


@query(cq.ORACLE_SQL["linear_merge"])
def bytes_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = LinearSpec(8192)
    parts = [stored(c.linear_build(x, "l_partkey", [], spec), [], "linear", m=spec.m) for x in _line_halves(spark, sf_dir)]
    return c.linear_estimate(c.linear_merge(*parts), [], spec).select("num_bits", "bits_set", r6("fill_ratio"), r6("estimate"), "should_transition")


@query(cq.ORACLE_SQL["hybrid_counter"])
def bytes_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid states of two parts, stored, merged and asked."""
    rows, spec = cq._months(spark, sf_dir), cq.HYBRID
    parts = [stored(c.hybrid_build(rows.where(w), "o_custkey", ["month"], spec), ["month"], "hybrid", most=2000) for w in ("o_custkey % 2 = 0", "o_custkey % 2 = 1")]
    return c.hybrid_statistics(c.hybrid_merge(*parts, ["month"]), ["month"], spec).select("month", "mode", r6("estimate"))


@query(tq.ORACLE_SQL["theta_union"])
def bytes_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stored(x, [], "theta", k=1024) for x in tq._flags(spark, sf_dir)]
    return t.theta_estimate(t.theta_union(*parts, [], tq.SPEC), []).select("retained", r6("estimate"))


@query(tq.ORACLE_SQL["tuple_union"])
def bytes_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stored(x, [], "tuple", "h long, revenue long, lines long, theta long", k=1024) for x in tq._tuple_sides(spark, sf_dir)]
    return t.tuple_union(*parts, {"revenue": "sum", "lines": "sum"}, [], tq.SPEC).select("h", "revenue", "lines")


@query(tq.ORACLE_SQL["aod_union"])
def bytes_aod(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [tq._aod(spark, sf_dir, w) for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    parts = [stored(x.select("h", "theta", "values", "seq"), [], "aod", "h long, theta long, values array<double>, seq long", capacity=512, num_values=2) for x in sides]
    return t.aod_union(*parts, [], tq.AOD).select("h", F.col("values")[0].alias("price"))


@query(mq.ORACLE_SQL["bloom_merge"])
def bytes_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stored(b.bloom_build(x, "l_partkey", [], mq.SPEC), [], "bloom", m=mq.SPEC.m, k=mq.SPEC.k) for x in _line_halves(spark, sf_dir)]
    return b.bloom_merge(*parts).agg(F.count(F.lit(1)).alias("bits_set"))


@query(mq._COUNT.format(tab="(select user_id from events)"))
def bytes_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    parts = [stored(b.counting_build(rows.where(w), "user_id", [], mq.SPEC), [], "counting", m=mq.SPEC.m) for w in ("event_id % 2 = 0", "event_id % 2 = 1")]
    return b.counting_merge(parts[0].unionByName(parts[1]), [])


@query(f"with {fq._matrix('l_partkey', 'lineitem')} select r as row, c::int as col, n from m")
def bytes_countmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stored(f.matrix_build(x, "l_partkey", [], fq.SPEC), [], "countmin", width=512, depth=5) for x in _line_halves(spark, sf_dir)]
    return f.matrix_merge(*parts, [])


@query(f"with {fq._matrix('l_partkey', 'lineitem', True)} select r as row, c::int as col, n from m where n <> 0")
def bytes_countsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stored(f.matrix_build(x, "l_partkey", [], fq.SPEC, signed=True), [], "countsketch", width=512, depth=5) for x in _line_halves(spark, sf_dir)]
    return f.matrix_merge(*parts, []).where("n <> 0")


@query("select event_type as item, count(*) as n, 0::bigint as off, (select count(*) from events) as total from events group by 1")
def bytes_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spec = table(spark, sf_dir, "events"), FrequentSpec(16)
    parts = [stored(f.frequent_build(rows.where(w), "event_type", spec), [], "frequent", max_map_size=16) for w in ("event_id % 2 = 0", "event_id % 2 = 1")]
    return f.frequent_merge(*parts, spec).select("item", "n", F.col("offset").alias("off"), "total")


@query(sq.ORACLE_SQL["reservoir_merge"])
def bytes_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id")
    parts = [stored(s.uniform_sample(rows.where(w), "event_id", sq.SPEC, seed=7), [], "sample", "event_id long, sample_hash long", k=200) for w in ("event_id % 3 = 0", "event_id % 3 <> 0")]
    return s.merge_uniform(*parts, "event_id", sq.SPEC)


@query(sq.ORACLE_SQL["varopt_subset_sum"])
def bytes_varopt(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "o_orderkey long, o_orderstatus string, w double, tau double, adjusted double"
    sample = stored(s.varopt_sample(sq._skewed(spark, sf_dir), "o_orderkey", "w", sq.SPEC, seed=9), [], "varopt", columns, k=200)
    chosen = F.sum(F.when(F.col("o_orderstatus") == "F", F.col("adjusted")).otherwise(F.lit(0.0)))
    return sample.agg(F.count(F.lit(1)).alias("kept"), F.round(chosen / F.lit(1e6), 2).alias("estimate_f_millions"))


@query("select o_orderstatus, count(*) as n, min(o_totalprice) as min, max(o_totalprice) as max from orders group by 1")
def bytes_kll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native state as a stored column, merged after it was written and read."""
    rows, path = table(spark, sf_dir, "orders"), f"{shared_dir(spark)}/kll-{uuid.uuid4().hex}"
    states = quantiles.kll_build(rows.withColumn("half", F.col("o_orderkey") % 2), "o_totalprice", ["o_orderstatus", "half"])
    codec.write_state(states, path, "kll", {"k": 200})
    merged = quantiles.kll_merge(codec.read_state(spark, path, "kll", {"k": 200}), ["o_orderstatus"])
    return merged.select("o_orderstatus", F.kll_sketch_get_n_double("sketch").alias("n"), "min", "max")


def _digests(spark: SparkSession, sf_dir: str, build, parse) -> DataFrame:
    """States of two halves as bytes, merged."""
    rows = table(spark, sf_dir, "events")
    parts = [build(rows.where(w), "value", ["event_type"]) for w in ("event_id % 2 = 0", "event_id % 2 = 1")]
    return quantiles.merge_states(parts[0].unionByName(parts[1]), ["event_type"], parse)


@query("select event_type, count(*) as n, min(value) as min, max(value) as max from events group by 1")
def bytes_req(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _digests(spark, sf_dir, quantiles.req_build, quantiles.Req.from_bytes)
    return quantiles.statistics(merged, ["event_type"], quantiles.Req.from_bytes).select("event_type", "n", "min", "max")


@query("select event_type, count(*) as n, min(value) as min, max(value) as max from events group by 1")
def bytes_tdigest(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _digests(spark, sf_dir, quantiles.tdigest_build, quantiles.TDigest.from_bytes)
    return quantiles.statistics(merged, ["event_type"], quantiles.TDigest.from_bytes).select("event_type", "n", "min", "max")


@query(f"""select 'hll' as family, 12::bigint as parameter, true as refused from range(1) union all select 'cpc', 11, true""")
def bytes_of_another_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of another family, another parameter, or cut short are refused."""
    blob = codec.to_bytes(c.hll_build(table(spark, sf_dir, "orders"), "o_custkey", []), [], "hll", {"p": 12})

    def refused(data: DataFrame, family: str, parameters: dict) -> bool:
        try:
            codec.from_bytes(data, [], family, parameters).collect()
        except Exception as e:  # raised in a task, so it comes as Spark's own
            return "CodecError" in str(e)
        return False

    short = blob.withColumn("state", F.expr("substring(state, 1, length(state) - 3)"))
    bad = refused(blob, "hll", {"p": 13}) and refused(short, "hll", {"p": 12})
    return spark.createDataFrame([("hll", 12, bad), ("cpc", 11, refused(blob, "cpc", {"lg_k": 11}))], "family string, parameter long, refused boolean")


# -- statistics and sizes -------------------------------------------------------------------------------------------------


@query(
    f"""select month, case when {cq._STAY} then used::bigint else -1 end as bits_set, case when {cq._STAY} then round(used / {cq._M}, 4) else -1.0::double end as fill_ratio, {cq.HYBRID.threshold}::bigint as transition_threshold,
    case when {cq._STAY} then {cq._M // 8} else {cq.HYBRID.hll.m} end::bigint as memory_usage from
    (select month, used, case when used >= {cq._M} then {1.5 * cq._M}::double else -{cq._M}::double * ln(({cq._M}::double - used) / {cq._M}::double) end as lin
     from (select month, count(distinct ({q.h60("o_custkey")}) % {cq._M})::double as used from {cq.MONTHS} group by 1))"""
)
def hybrid_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = c.hybrid_build(cq._months(spark, sf_dir), "o_custkey", ["month"], cq.HYBRID)
    out = c.hybrid_statistics(state, ["month"], cq.HYBRID)
    shown = F.coalesce("bits_set", F.lit(-1)).alias("bits_set"), F.coalesce(F.round("fill_ratio", 4), F.lit(-1.0)).alias("fill_ratio")
    return out.select("month", *shown, "transition_threshold", "memory_usage")


@query(
    f"""select 'hll' as family, count(*) as entries, 8 * count(*) as memory_usage from ({q.hll_registers("orders", "o_custkey", "", 12)})
    union all select 'cpc', count(*), 12 * count(*) from ({cq._cpc_rows("orders", "o_custkey", 10)})
    union all select 'linear', count(*), 4 * count(*) from (select distinct ({q.h60("o_custkey")}) % 4096 from orders)
    union all select 'theta', count(*), 16 * count(*) from ({q.theta_state("orders", "o_custkey", 256)})
    union all select 'bloom', count(*), 8 * count(*) from ({mq._positions("o_custkey", "orders")})
    union all select 'frequent', count(distinct o_orderstatus), 25 * count(distinct o_orderstatus) from orders"""
)
def state_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    states = {
        "hll": c.hll_build(rows, "o_custkey", [], HllSpec(12)), "cpc": c.cpc_build(rows, "o_custkey", [], CpcSpec(10)), "linear": c.linear_build(rows, "o_custkey", [], LinearSpec(4096)),
        "theta": t.theta_build(rows, "o_custkey", [], ThetaSpec(256)), "bloom": b.bloom_build(rows, "o_custkey", [], mq.SPEC), "frequent": f.frequent_build(rows, "o_orderstatus", FrequentSpec(16)),
    }
    sizes = [c.state_size(x, []).select(F.lit(k).alias("family"), "entries", "memory_usage") for k, x in states.items()]
    return c.merge_many(sizes, lambda x: x)


@query("select l_returnflag, 200::bigint as k, count(*) as total_count, min(l_extendedprice) as min, max(l_extendedprice) as max, true as min_value_set, true as max_value_set, true as small from lineitem group by 1")
def kll_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quantiles.kll_statistics(quantiles.kll_build(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), ["l_returnflag"])
    return stats.withColumn("small", F.col("memory_usage") < 20_000).drop("memory_usage")


@query("select l_returnflag, count(*) as n, min(l_extendedprice) as min, max(l_extendedprice) as max, true as bounded, true as has_levels from lineitem group by 1")
def req_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items kept and levels of REQ states; the levels' weights add up to the rows, so their number follows from both."""
    stats = quantiles.statistics(quantiles.req_build(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"]), ["l_returnflag"], quantiles.Req.from_bytes)
    return stats.select("l_returnflag", "n", "min", "max", (F.col("retained") <= F.least(F.col("n"), F.lit(20_000))).alias("bounded"), ((F.col("levels") > 1) == (F.col("retained") < F.col("n"))).alias("has_levels"))


_RANKS = {"r1": 20000.0, "r2": 60000.0, "r3": 90000.0}


@query(
    "select l_returnflag, " + ", ".join(f"round(avg((l_extendedprice <= {x})::double), 1) as {k}" for k, x in _RANKS.items()) + ", true as cdf_ok, true as pmf_ok from lineitem group by 1"
)
def req_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, distribution and mass by REQ; the exact ranks are shown to one digit where REQ's agree to 0.04."""
    rows, keys = table(spark, sf_dir, "lineitem"), ["l_returnflag"]
    state = quantiles.req_build(rows, "l_extendedprice", keys)
    splits = list(_RANKS.values())
    asks = {k: (lambda st, x=x: st.rank(x)) for k, x in _RANKS.items()}
    asks |= {f"c{i}": (lambda st, i=i: st.cdf(splits)[i]) for i in range(4)} | {"mass": lambda st: sum(st.pmf(splits))}
    exact = rows.groupBy(*keys).agg(*[F.avg((F.col("l_extendedprice") <= x).cast("double")).alias(f"e_{k}") for k, x in _RANKS.items()])
    both = quantiles.ask(state, keys, quantiles.Req.from_bytes, asks).join(exact, keys)
    shown = [F.when(F.abs(F.col(k) - F.col(f"e_{k}")) <= 0.04, F.round(f"e_{k}", 1)).otherwise(F.col(k)).alias(k) for k in _RANKS]
    cdf = (F.col("c0") == F.col("r1")) & (F.col("c1") == F.col("r2")) & (F.col("c2") == F.col("r3")) & (F.col("c3") == 1)
    return both.select(*keys, *shown, cdf.alias("cdf_ok"), (F.abs(F.col("mass") - 1) < 1e-9).alias("pmf_ok"))


@query("select event_type, round(avg((value <= 50)::double), 1) as r50, round(avg((value <= 100)::double), 1) as r100 from events group by 1")
def tdigest_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by digests of a stated accuracy, merged from two halves; exact ranks are shown where the digest's agree to 0.02."""
    rows, spec = table(spark, sf_dir, "events"), TDigestSpec.for_error(0.002)
    merged = _digests(spark, sf_dir, lambda d, v, k: quantiles.tdigest_build(d, v, k, spec), quantiles.TDigest.from_bytes)
    asked = quantiles.ask(merged, ["event_type"], quantiles.TDigest.from_bytes, {"r50": lambda st: st.rank(50.0), "r100": lambda st: st.rank(100.0)})
    exact = rows.groupBy("event_type").agg(F.avg((F.col("value") <= 50).cast("double")).alias("e_r50"), F.avg((F.col("value") <= 100).cast("double")).alias("e_r100"))
    shown = [F.when(F.abs(F.col(k) - F.col(f"e_{k}")) <= 0.02, F.round(f"e_{k}", 1)).otherwise(F.col(k)).alias(k) for k in ("r50", "r100")]
    return asked.join(exact, "event_type").select("event_type", *shown)


@query("select count(*) as items_seen, least(count(*), 200) as sample_size, 200::bigint as capacity, count(*) >= 200 as is_full from events")
def sample_state_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read off the merged sample itself."""
    rows = table(spark, sf_dir, "events").select("event_id")
    parts = [s.uniform_state(rows.where(w), "event_id", sq.SPEC, seed=7) for w in ("event_id % 3 = 0", "event_id % 3 <> 0")]
    return s.state_statistics(s.merge_uniform_states(*parts, "event_id", sq.SPEC), sq.SPEC)


# -- merges of many, roll-ups ---------------------------------------------------------------------------------------------

_FLAGS = [(fl, st) for fl in "ANR" for st in "FO"]


@query(f"select count(*) as retained, round({q.theta_estimate()}, 4) as estimate from ({q.theta_state('lineitem', 'l_orderkey', 1024)})")
def theta_union_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six states united at once equal the state of all rows."""
    rows = table(spark, sf_dir, "lineitem")
    states = [t.theta_build(rows.where((F.col("l_returnflag") == x) & (F.col("l_linestatus") == y)), "l_orderkey", [], tq.SPEC) for x, y in _FLAGS]
    return t.theta_estimate(t.theta_union_many(states, [], tq.SPEC), []).select("retained", r6("estimate"))


@query(
    "with "
    + ", ".join(f"s{i} as ({q.theta_state('lineitem', 'l_partkey', 1024, f'l_linenumber = {i}')})" for i in (1, 2, 3))
    + f""", top as (select least((select min(theta) from s1), (select min(theta) from s2), (select min(theta) from s3)) as theta)
    select count(*) as retained, round({q.theta_estimate("min(theta)")}, 4) as estimate from s1 join (select h from s2) using (h) join (select h from s3) using (h), (select theta as m from top) where h < m"""
    .replace("min(theta)", "min(m)")
    .replace("(select min(m) from s1), (select min(m) from s2), (select min(m) from s3)", "(select min(theta) from s1), (select min(theta) from s2), (select min(theta) from s3)")
)
def theta_intersect_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    states = [t.theta_build(rows.where(f"l_linenumber = {i}"), "l_partkey", [], tq.SPEC) for i in (1, 2, 3)]
    return t.theta_estimate(t.theta_intersect_many(states, []), []).select("retained", r6("estimate"))


@query(cq.ORACLE_SQL["cpc_icon_orders"])
def cpc_merge_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    states = [c.cpc_build(rows.where(F.col("l_linenumber") == i), "l_orderkey", []) for i in range(1, 8)]
    return c.cpc_estimate(c.merge_many(states, lambda x: c.cpc_combine(x, [])), []).select("coupons", "flavor", r6("estimate"))


@query(f"""select p_brand, round({q.hll_estimate(10, cq.HLLPP_THRESHOLDS[6])}, 4) as estimate from ({q.hll_registers("part", "p_partkey", "p_brand, ", 10)}) group by p_brand""")
def hllpp_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spec = table(spark, sf_dir, "part"), HllSpec(10)
    states = [c.hll_build(rows.where(F.col("p_size") % 4 == i), "p_partkey", ["p_brand"], spec) for i in range(4)]
    return c.hllpp_estimate(c.merge_many(states, lambda x: c.hll_combine(x, ["p_brand"])), ["p_brand"], spec).select("p_brand", r6("estimate"))


_CUBE = "(select l_returnflag as flag, l_linestatus as status, l_partkey from lineitem)"


@query(
    " union all ".join(
        f"select {a} as flag, {z} as status, round({q.hll_estimate(10)}, 4) as estimate from ({q.hll_registers(_CUBE, 'l_partkey', keys, 10)}) {'group by ' + keys.rstrip(', ') if keys else ''}"
        for a, z, keys in (("flag", "status", "flag, status, "), ("flag", "'all'", "flag, "), ("'all'", "status", "status, "), ("'all'", "'all'", ""))
    )
)
def hll_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groupings of two keys, from the states of the finest."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_partkey")
    fine = c.hll_build(rows, "l_partkey", ["flag", "status"], HllSpec(10))
    out = []
    for keys in (["flag", "status"], ["flag"], ["status"], []):
        est = c.hll_estimate(c.hll_combine(fine, keys), keys, HllSpec(10))
        out.append(est.select(*[F.col(k) if k in keys else F.lit("all").alias(k) for k in ("flag", "status")], r6("estimate")))
    return c.merge_many(out, lambda x: x)


# -- tuple summaries ------------------------------------------------------------------------------------------------------


@query(
    f"""with {tq._TUPLE.format(where="true")}, top as (select coalesce((select h from n where i = 1025), {tq.FULL}) as theta)
    select o_orderkey, revenue is not null as found, coalesce(revenue, 0) as revenue, coalesce(lines, 0) as lines from (select o_orderkey, {q.h60("o_orderkey")} as h from orders where o_orderkey % 10 = 0) left join (select n.* from n, top where i <= 1024 and h < theta) using (h)"""
)
def tuple_get_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of given items; null for those that were let go."""
    state = t.tuple_build(tq._lines(spark, sf_dir), "l_orderkey", tq.SUMS, [], tq.SPEC)
    found = t.tuple_get(state, table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0"), "o_orderkey")
    return found.select("o_orderkey", F.col("revenue").isNotNull().alias("found"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("revenue", "lines")])


@query(f"""with {tq._TUPLE.format(where="l_returnflag = 'A'")} select count(*) as entries, min(h) as least, sum(lines)::bigint as lines from n where i <= 1024""")
def tuple_summary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = t.tuple_build(tq._lines(spark, sf_dir).where("l_returnflag = 'A'"), "l_orderkey", tq.SUMS, [], tq.SPEC)
    whole = t.tuple_map(state, [], ["revenue", "lines"])
    lines = F.aggregate(F.map_values("summaries"), F.lit(0).cast("bigint"), lambda a, x: a + x["lines"])
    return whole.select(F.size("summaries").cast("bigint").alias("entries"), F.array_min(F.map_keys("summaries")).alias("least"), lines.alias("lines"))


_ARRAYS = lambda w: f"""select {q.h60("o_custkey")} as h, sum(round(o_totalprice))::double as price, count(*)::double as orders, max(o_orderkey) as newest from orders where {w} group by 1"""
_BOTH = f"""x as ({_ARRAYS("o_orderstatus = 'F'")}), y as ({_ARRAYS("o_orderstatus <> 'F'")})"""


def _array_sides(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], dict]:
    """States with an array summary and one of the caller's own, of two parts of the orders; room for all hashes."""
    newest = theta.Summary(F.max, F.max, F.greatest)
    rows = table(spark, sf_dir, "orders").withColumn("v", F.array(F.round("o_totalprice"), F.lit(1.0)))
    how = {"sums": (theta.array_sum(2), "v"), "newest": (newest, "o_orderkey")}
    sides = [t.tuple_build(rows.where(w), "o_custkey", how, [], ThetaSpec(1 << 20)) for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'")]
    return sides, {k: x for k, (x, _) in how.items()}


@query(f"with {_BOTH} select h, sum(price) as price, sum(orders) as orders, max(newest) as newest from (select * from x union all select * from y) group by 1")
def tuple_array_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides, how = _array_sides(spark, sf_dir)
    return t.tuple_union(*sides, how, [], ThetaSpec(1 << 20)).select("h", F.col("sums")[0].alias("price"), F.col("sums")[1].alias("orders"), "newest")


@query(f"with {_BOTH} select h, x.price + y.price as price, x.orders + y.orders as orders, greatest(x.newest, y.newest) as newest from x join y using (h)")
def tuple_array_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides, how = _array_sides(spark, sf_dir)
    return t.tuple_intersect(*sides, how, []).select("h", F.col("sums")[0].alias("price"), F.col("sums")[1].alias("orders"), "newest")


# -- frequencies ----------------------------------------------------------------------------------------------------------


@query("select event_type as item, sum(event_id % 7)::bigint as n from events group by 1")
def freq_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 7)
    return f.frequent_build(rows, "event_type", FrequentSpec(16), "w").select("item", "n")


@query("with n as (select l_suppkey::varchar as item, count(*) as n from lineitem group by 1) select item, n from n where n > (select 0.0105 * sum(n) from n)")
def freq_no_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for all items the lower bounds are exact, so only true heavy items are named."""
    rows = table(spark, sf_dir, "lineitem").withColumn("item", F.col("l_suppkey").cast("string"))
    summary = f.frequent_build(rows, "item", FrequentSpec.for_error(0.0005))
    total = F.col("total") * F.lit(0.0105)
    return f.frequent_items(summary.withColumn("total", F.col("total")), fraction=0.0105, no_false_positives=True).join(summary.select("item", "total"), "item").where(F.col("lower") > total).select("item", F.col("lower").alias("n"))


@query("select l_suppkey::varchar as item, count(*) as estimate from lineitem group by 1 order by 2 desc, 1 limit 15")
def freq_summary_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's own top items; it has room for every supplier."""
    rows = table(spark, sf_dir, "lineitem")
    return f.top_k(f.frequent_build(rows, "l_suppkey", FrequentSpec(100_000)), 15).select("item", "estimate")


@query("select count(distinct user_id) as users, true as never_under, true as no_larger from events")
def countmin_conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conservative updates of one stream in order: never under the true count, and never over the plain table's estimate in total."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("u"))
    spec = MatrixSpec.for_error(0.02, 0.05)

    def run(batches):
        import pandas as pd

        cells, true = sequential.ConservativeCountMin(spec), {}
        for part in batches:
            for u in part["u"]:
                cells.update(u.encode())
                true[u] = true.get(u, 0) + 1
        if true:
            yield pd.DataFrame([(u, n, cells.estimate(u.encode())) for u, n in true.items()], columns=["u", "n", "estimate"])

    found = rows.repartitionByRange(1, "event_id").sortWithinPartitions("event_id").mapInPandas(run, "u string, n long, estimate long")  # one stream
    plain = f.matrix_query(f.matrix_build(rows, "u", [], spec), rows, "u", spec).select("u", F.col("estimate").alias("plain"))
    both = found.join(plain, "u")
    return both.agg(F.count(F.lit(1)).alias("users"), F.bool_and(F.col("estimate") >= F.col("n")).alias("never_under"), (F.sum("estimate") <= 1.1 * F.sum("plain")).alias("no_larger"))


# -- filters --------------------------------------------------------------------------------------------------------------

_SMALL = BloomSpec(2000, 0.01, 15)


@query(f"select pos, least(n, 15) as n from ({mq._COUNT.format(tab='events')})")
def counting_bloom_saturates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters read as 15 at most."""
    return b.counters(b.counting_build(table(spark, sf_dir, "events"), "user_id", [], _SMALL), _SMALL)


@query("select user_id, user_id % 3 = 0 as removed from (select distinct user_id from events where user_id % 6 in (0, 1))")
def counting_bloom_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every item asked to go, whether it was there to be removed: users divisible by three were added, be they more than the filter is made for."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    spec = BloomSpec(20_000, 0.0001)
    added = users.where("user_id % 3 = 0")
    return b.counting_removed(b.counting_build(added, "user_id", [], spec), added, users.where("user_id % 6 in (0, 1)"), "user_id", spec)


# -- parameters, hashes, sources, functions -------------------------------------------------------------------------------


@query(
    """select 'hll' as family, 4096 as a, 12 as b union all select 'theta', 1024, 1000 union all select 'linear', 10048, 10000 union all select 'linear for error', 100032, 100000
    union all select 'hybrid', 1600, 10 union all select 'countmin', 272, 3 union all select 'frequent', 350, 350 union all select 'kll', 330, 330 union all select 'tdigest', 125, 125"""
)
def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that follow from parameters and error bounds."""
    hybrid, matrix = HybridSpec.for_range(16_000), MatrixSpec.for_error(0.01, 0.05)
    rows = [
        ("hll", HllSpec(12).m, HllSpec(12).p), ("theta", ThetaSpec(1000).nominal, 1000), ("linear", LinearSpec(10_000).m, 10_000),
        ("linear for error", LinearSpec.for_cardinality(1000, 0.1).m, LinearSpec.for_cardinality(1000, 0.1).num_bits), ("hybrid", hybrid.linear.num_bits, hybrid.hll.p - 2),
        ("countmin", matrix.width, matrix.depth), ("frequent", FrequentSpec.for_error(0.01).max_map_size, 350), ("kll", KllSpec.for_error(0.01).k, 330), ("tdigest", int(TDigestSpec.for_error(0.002).compression), 125),
    ]
    return spark.createDataFrame(rows, "family string, a int, b int")


@query(f"""select o_custkey, {q.h60("o_custkey", "7:")} as h, {q.part32("o_custkey", 0)} as first, {q.part32("o_custkey", 5)} as sixth from (select distinct o_custkey from orders)""")
def hashes_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salted hashes and independent parts."""
    items = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    parts = q.PORTABLE.parts("o_custkey", 6)
    return items.select("o_custkey", q.PORTABLE.h60("o_custkey", "7:").alias("h"), parts[0].alias("first"), parts[5].alias("sixth"))


@query("select count(distinct l_orderkey) as exact, true as fast_ok, true as murmur_ok, true as seeds_differ from lineitem")
def hashers_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates by the other hashes lie within 6 % as well, and salted hashes of an item differ."""
    rows = table(spark, sf_dir, "lineitem")
    exact = rows.agg(F.count_distinct("l_orderkey").alias("exact"))
    sides = [cardinality.hll_estimate(cardinality.hll_build(rows, "l_orderkey", [], hasher=h), [], name=n) for n, h in (("fast", FAST), ("murmur", MURMUR3))]
    salted = rows.agg(F.bool_and(FAST.h60("l_orderkey", "1:") != FAST.h60("l_orderkey", "2:")).alias("seeds_differ"))
    near = lambda k: (F.abs(F.col(k) - F.col("exact")) <= 0.06 * F.col("exact")).alias(f"{k}_ok")
    return exact.crossJoin(sides[0]).crossJoin(sides[1]).crossJoin(salted).select("exact", near("fast"), near("murmur"), "seeds_differ")  # one row each


@query("select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey")
def delimited_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as text with different delimiters are read with the delimiter found from their headers."""
    found = {}
    for name, mark in (("nation", "|"), ("region", ";")):
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        rows = table(spark, sf_dir, name)
        rows.coalesce(1).write.option("header", True).option("sep", mark).csv(path)
        found[name] = delimited(spark, path, rows._jdf.schema().toDDL())
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query(f"select idx::int as idx, max(rank)::int as rank from ({q.hll_registers('orders', 'o_custkey', '', 8)}) group by 1")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registers built in SQL with the registered functions."""
    register(spark)
    view = f"orders_{uuid.uuid4().hex}"
    table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return spark.sql(f"select idx, max(rank) as rank from (select hll_index(h, 8) as idx, hll_rank(h, 8) as rank from (select h60(cast(o_custkey as string)) as h from {view})) group by 1")


@query("select event_type, min(value) as lowest, max(value) as highest from events group by 1")
def sql_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregates and questions of digests in SQL."""
    register(spark)
    view = f"events_{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").createOrReplaceTempView(view)
    return spark.sql(f"select event_type, tdigest_quantile(a, 0.0D) as lowest, req_quantile(z, 1.0D) as highest from (select event_type, tdigest_agg(value) as a, req_agg(value) as z from {view} group by event_type)")


@query(f"""select sum(bit_count(b))::bigint as coupons, true as polynomial_agrees from ({cq._cpc_rows("lineitem", "l_orderkey", 11)})""")
def cpc_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polynomial for lg_k = 11 and the inverse of ICON's definition, which other sizes use, agree to a thousandth."""
    out = c.cpc_estimate(c.cpc_build(table(spark, sf_dir, "lineitem"), "l_orderkey", []), [])
    invert = F.pandas_udf(lambda x: x.__class__(cardinality.icon_inverse(x.to_numpy(dtype=float), 11)), "double")
    return out.select("coupons", (F.abs(invert("coupons") / F.col("estimate") - 1) < 0.001).alias("polynomial_agrees"))


@query("select year(o_orderdate) as year, count(distinct o_custkey) as exact, true as hip_ok, true as cpc_ok from orders group by 1")
def sequential_estimators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIP estimates of HLL and CPC, one stream per year in the order of keys, within 5 % of the exact count."""
    rows = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), "o_orderkey", F.col("o_custkey").cast("string").alias("item"))

    def run(key, part):
        import pandas as pd

        items = [x.encode() for x in part.sort_values("o_orderkey")["item"]]
        hll, cpc = sequential.HipHll(HllSpec(12)).update(items).estimate(), sequential.HipCpc(CpcSpec(12)).update(items).estimate()
        return pd.DataFrame([(key[0], len(set(items)), hll, cpc)], columns=["year", "exact", "hll", "cpc"])

    found = rows.groupBy("year").applyInPandas(lambda k, part: run(k, part), "year long, exact long, hll double, cpc double")
    near = lambda k: F.abs(F.col(k) - F.col("exact")) <= 0.05 * F.col("exact") + 2
    return found.select("year", "exact", near("hll").alias("hip_ok"), near("cpc").alias("cpc_ok"))


_AOD_SMALL = AodSpec(1 << 20, 1)


@query("select count(distinct o_custkey) as entries, round(sum(p), 0) as total from (select o_custkey, max_by(o_totalprice, o_orderkey) as p from orders group by 1)")
def aod_exact_below_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    out = t.aod_estimate(t.aod_build(rows, "o_custkey", ["o_totalprice"], "o_orderkey", [], _AOD_SMALL), [], _AOD_SMALL)
    return out.select("entries", F.round(F.col("sums")[0], 0).alias("total"))


@query("select l_returnflag, count(*) as n, true as p99_ok from lineitem group by 1")
def req_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REQ states of single lines' numbers merged by flag: the 99th percentile holds to 0.4 %."""
    rows = table(spark, sf_dir, "lineitem")
    parts = quantiles.req_build(rows, "l_extendedprice", ["l_returnflag", "l_linenumber"], ReqSpec(12, "HRA"))
    merged = quantiles.merge_states(parts.select("l_returnflag", "sketch"), ["l_returnflag"], quantiles.Req.from_bytes)
    asked = quantiles.ask(merged, ["l_returnflag"], quantiles.Req.from_bytes, {"p99": lambda st: st.quantile(0.99)})
    from .quantiles import _ranked

    return _ranked(rows, "l_extendedprice", ["l_returnflag"], asked, {"p99": (0.99, 0.004)})


@query(f"""select p_brand, count(*) as entries, count(*) * 33 <= {0.25 * (1 << 12)}::double as is_sparse from ({q.hll_registers("part", "p_partkey", "p_brand, ", 12)}) group by p_brand""")
def hll_threshold_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = HllSpec(12)
    return c.hll_density(c.hll_build(table(spark, sf_dir, "part"), "p_partkey", ["p_brand"], spec), ["p_brand"], spec, ratio=0.25)


@query(f"""select idx * 64 + rank as coupon, count(*) as n from (select h >> {BITS - 10} as idx, {BITS - 9} - {q.bits(f"(h & {(1 << (BITS - 10)) - 1})")} as rank from (select {q.h60("o_custkey")} as h from orders)) group by 1""")
def hll_coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and value of every item as one number."""
    coupons = c.hll_coupons(table(spark, sf_dir, "orders"), "o_custkey", [], HllSpec(10))
    return coupons.groupBy((F.col("idx").cast("bigint") * 64 + F.col("rank")).alias("coupon")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""select round({q.hll_estimate(6)}, 4) as estimate from ({q.hll_registers("orders", "o_custkey", "", 6)})""")
def hll_from_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state made from all registers, zeros included, answers as the one they came from."""
    spec = HllSpec(6)
    dense = c.dense_registers(c.hll_build(table(spark, sf_dir, "orders"), "o_custkey", [], spec), [], spec)
    return c.hll_estimate(c.hll_combine(dense.where("rank > 0"), []), [], spec).select(r6("estimate"))


@query("select count(*) as n, least(count(*), 100) as kept from events")
def sample_of_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return s.sample_statistics(rows, "event_id", SampleSpec(100)).select(F.col("items_seen").alias("n"), F.col("sample_size").alias("kept"))
