"""Queries of frequency tables and frequent items with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spec import FrequentSpec, MatrixSpec
from ..operators import frequency
from ..sources.tables import table
from . import sql as q

f = q.Portable(frequency)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
SPEC = MatrixSpec(512, 5)


def query(oracle: str):
    def add(fn):
        QUERIES[fn.__name__], ORACLE_SQL[fn.__name__] = fn, oracle
        return fn

    return add


def _matrix(item: str, tab: str, signed: bool = False) -> str:
    """Cells of each distinct item: item, r, c, s, n."""
    parts = []
    for r in range(SPEC.depth):
        h = q.part32(item, r)
        col, sign = (f"({h} >> 1)", f"1 - 2 * ({h} & 1)") if signed else (h, "1")
        parts.append(f"select item, n, {r} as r, ({col}) % {SPEC.width} as c, {sign} as s from i")
    return f"i as (select {item} as {item}, {item} as item, count(*) as n from {tab} group by 1), cells as ({' union all '.join(parts)}), m as (select r, c, sum(n * s)::bigint as n from cells group by all)"


@query(f"with {_matrix('l_partkey', 'lineitem')} select item as l_partkey, min(m.n) as estimate from cells join m using (r, c) group by 1")
def countmin_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return f.matrix_query(f.matrix_build(rows, "l_partkey", [], SPEC), rows, "l_partkey", SPEC)


@query(
    f"""with {_matrix("l_partkey", "lineitem")}, rs as (select r, sum(n)::bigint as s, count(*) filter (n <> 0) as c, max(n) as hi, min(n) as lo from m group by 1)
    select {SPEC.width}::bigint as width, {SPEC.depth}::bigint as depth, {SPEC.width * SPEC.depth}::bigint as total_cells, sum(c)::bigint as non_zero_cells, round(sum(c)::double / {SPEC.width * SPEC.depth}, 4) as fill_ratio,
    min(s) as total_count, max(hi) as max_count, case when sum(c) = {SPEC.width * SPEC.depth} then min(lo) else 0 end as min_count from rs"""
)
def countmin_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    halves = [f.matrix_build(rows.where(w), "l_partkey", [], SPEC) for w in ("l_linenumber <= 3", "l_linenumber > 3")]
    return f.matrix_statistics(f.matrix_merge(*halves, []), SPEC).withColumn("fill_ratio", F.round("fill_ratio", 4))


@query(f"with {_matrix('event_type', 'events')} select distinct n from m where n >= 1500")
def countmin_heavy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.heavy_cells(f.matrix_build(table(spark, sf_dir, "events"), "event_type", [], SPEC), 1500)


@query(f"with {_matrix('l_partkey', 'lineitem')}, e as (select item, min(m.n) as estimate from cells join m using (r, c) group by 1) select item as l_partkey, estimate from e where estimate >= 150")
def countmin_heavy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return f.heavy_items(rows, "l_partkey", f.matrix_build(rows, "l_partkey", [], SPEC), 150, SPEC)


@query(
    f"""with {_matrix("l_partkey", "lineitem", True)}, e as (select item, list(m.n * s order by m.n * s) as l from cells join m using (r, c) group by 1)
    select item as l_partkey, l[{SPEC.depth // 2 + 1}] as estimate from e"""
)
def countsketch_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return f.matrix_query(f.matrix_build(rows, "l_partkey", [], SPEC, signed=True), rows, "l_partkey", SPEC, signed=True)


@query("select event_type as item, count(*) as exact, true as in_bounds from events group by 1")
def freq_event_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With room for all items a summary is exact; the bounds hold the true count."""
    rows = table(spark, sf_dir, "events")
    found = f.frequent_items(f.frequent_build(rows, "event_type", FrequentSpec(16)), threshold=0)
    exact = rows.groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("exact"))
    return exact.join(found, "item", "left").select("item", "exact", ((F.col("exact") >= F.col("lower")) & (F.col("exact") <= F.col("upper"))).alias("in_bounds"))


@query("select count(*) as exact_over, 0::bigint as missed, true as bounds_hold from (select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) where word <> '' group by 1) where n > (select floor(0.005 * count(*)) from (select unnest(string_split(text, ' ')) as word from documents) where word <> '')")
def freq_words_by_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words over 0.5 % of all: none is missed by a summary of 700 counters, and its bounds hold."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("word")).where("word <> ''")
    summary = f.frequent_build(words, "word", FrequentSpec.for_error(0.005))
    found = f.frequent_items(summary, fraction=0.005)
    exact = words.groupBy(F.col("word").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    total = exact.agg(F.floor(F.sum("n") * F.lit(0.005)).alias("t"))
    over = exact.crossJoin(F.broadcast(total)).where("n > t").join(found, "item", "left")  # one row
    held = F.coalesce((F.col("n") >= F.col("lower")) & (F.col("n") <= F.col("upper")), F.lit(False))
    return over.agg(F.count(F.lit(1)).alias("exact_over"), F.count_if(F.col("lower").isNull()).alias("missed"), F.bool_and(held).alias("bounds_hold"))


@query("select l_partkey::varchar as item, count(*) as n from lineitem group by 1 order by n desc, item limit 20")
def freq_topk_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.exact_top_k(table(spark, sf_dir, "lineitem"), "l_partkey", 20)


@query("select sum(n)::bigint as total, true as close from (select event_type, count(*) as n from events group by 1)")
def native_topk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's approx_top_k counts every one of five event types exactly when it has room for them."""
    rows = table(spark, sf_dir, "events")
    native = rows.agg(F.expr("approx_top_k(event_type, 5, 100)").alias("top")).select(F.explode("top").alias("x")).select("x.item", "x.count")
    both = rows.groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("n")).join(native, "item", "left")
    return both.agg(F.sum("n").alias("total"), F.bool_and(F.col("n") == F.col("count")).alias("close"))


@query("select count(*) as items, true as never_under from (select distinct l_partkey from lineitem)")
def countmin_never_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    est = f.matrix_query(f.matrix_build(rows, "l_partkey", [], SPEC), rows, "l_partkey", SPEC)
    both = est.join(rows.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), "l_partkey")
    return both.agg(F.count(F.lit(1)).alias("items"), F.bool_and(F.col("estimate") >= F.col("n")).alias("never_under"))





@query("select event_type as item, count(*) as exact, true as in_bounds from events group by 1")
def freq_merge_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with room for three of five types, of two halves of the rows, merged: the bounds hold the true count."""
    rows, spec = table(spark, sf_dir, "events"), FrequentSpec(3)
    halves = [f.frequent_build(rows.where(w), "event_type", spec) for w in ("event_id % 2 = 0", "event_id % 2 = 1")]
    asked = f.frequent_bounds(f.frequent_merge(*halves, spec), rows, "event_type")
    exact = rows.groupBy(F.col("event_type").alias("item")).agg(F.count(F.lit(1)).alias("exact"))
    return exact.join(asked, "item", "left").select("item", "exact", ((F.col("exact") >= F.col("lower")) & (F.col("exact") <= F.col("upper"))).alias("in_bounds"))


@query("select 16::bigint as max_map_size, count(distinct event_type) as current_map_size, count(*) as stream_length, count(*) as total_tracked_frequency, 0::bigint as \"offset\" from events")
def freq_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = FrequentSpec(16)
    return f.frequent_statistics(f.frequent_build(table(spark, sf_dir, "events"), "event_type", spec), spec)
