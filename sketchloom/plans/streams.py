"""Queries run as streams over the events table until its files are read (available now), with batch SQL as their counterpart."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.hashing import PORTABLE
from ..functions.spec import SampleSpec, TDigestSpec
from ..operators import quantiles as u
from ..sources.shared import shared_dir
from ..streaming import summaries as m

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, oracle
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def finished(stream: DataFrame, spark: SparkSession, mode: str) -> DataFrame:
    """The rows that the stream emitted, as a table in the shared folder: of the last trigger in complete mode, else of all of them."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.foreachBatch(m.into_table(f"{path}/rows")).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/progress").start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        rows = rows.join(F.broadcast(last), "batch")  # one row
    return rows.drop("batch")


@query("select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) as n, round(sum(value), 2) as total, true as users_in_bound from events group by all")
def stream_daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a day with an HLL state of the users; the estimate is within 5 % or 1 of the exact count."""
    aggs = {"n": F.count(F.lit(1)), "total": F.sum("value"), "users": m.distinct_state("user_id")}
    windows = m.windowed(_events(spark, sf_dir), "ts", "1 day", "60 days", aggs, ["event_type"]).withColumn("users", F.hll_sketch_estimate("users"))
    rows = finished(windows, spark, "complete").withColumn("day", F.date_format("start", "yyyy-MM-dd"))
    batch = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    exact = batch.groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count_distinct("user_id").alias("exact"))
    near = F.abs(F.col("users") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return rows.join(exact, ["event_type", "day"]).select("event_type", "day", "n", F.round("total", 2).alias("total"), near.alias("users_in_bound"))


@query(
    """select event_type, event_id::varchar as item from (select event_type, event_id,
    row_number() over (partition by event_type order by ('0x' || substr(md5('3:' || event_id::varchar), 1, 15))::bigint, event_id::varchar) as r from events) where r <= 25"""
)
def stream_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-type samples kept as stream state equal the batch sample."""
    emitted = finished(m.sample_stream(_events(spark, sf_dir), ["event_type"], "event_id", SampleSpec(25), seed=3, hasher=PORTABLE), spark, "update")
    return emitted.groupBy("event_type").agg(F.slice(F.array_sort(F.collect_set(F.struct("sample_hash", "item"))), 1, 25).alias("kept")).select("event_type", F.explode("kept.item").alias("item"))


@query("select event_type, count(*) as items_seen, true as is_full from events group by 1")
def stream_sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    emitted = finished(m.sample_stream(_events(spark, sf_dir), ["event_type"], "event_id", SampleSpec(25), seed=3), spark, "update")
    return emitted.groupBy("event_type").agg(F.max("items_seen").alias("items_seen"), F.bool_or("is_full").alias("is_full"))


@query(
    """with s as (select *, case when ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)),
    g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from s)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as first, count(*) as n, round(sum(value), 2) as total from g group by user_id, k"""
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users that end after six hours without an event (a session window also ends where the next event comes exactly then)."""
    aggs = {"n": F.count(F.lit(1)), "total": F.sum("value")}
    rows = finished(m.sessions(_events(spark, sf_dir), "ts", "21600.000001 seconds", "60 days", aggs, ["user_id"]), spark, "complete")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("first"), "n", F.round("total", 2).alias("total"))


@query(
    """select strftime(s, '%Y-%m-%d') as first_day, count(*) as n, count(distinct event_type) as types from
    (select event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) as s from events) group by 1"""
)
def stream_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two days that begin every day."""
    aggs = {"n": F.count(F.lit(1)), "types": F.size(F.collect_set("event_type")).cast("bigint")}
    rows = finished(m.windowed(_events(spark, sf_dir), "ts", "2 days", "60 days", aggs, slide="1 day"), spark, "complete")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("first_day"), "n", "types")


@query(
    """select event_type, count(*) as n, min(value) as min, max(value) as max, true as median_ok, true as same_as_batch from events group by 1"""
)
def stream_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests kept as stream state: read out, asked for statistics and the median, and as large as digests built in batch."""
    spec = TDigestSpec(200)
    emitted = finished(m.digest_states(_events(spark, sf_dir), ["event_type"], "value", spec), spark, "update")
    last = emitted.groupBy("event_type").agg(F.max_by("sketch", "n").alias("sketch"))
    stats = u.statistics(last, ["event_type"], u.TDigest.from_bytes).join(u.ask(last, ["event_type"], u.TDigest.from_bytes, {"p50": lambda s: s.quantile(0.5)}), "event_type")
    batch = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    built = u.statistics(u.tdigest_build(batch, "value", ["event_type"], spec), ["event_type"], u.TDigest.from_bytes).select("event_type", F.col("n").alias("n2"))
    exact = batch.join(stats.select("event_type", "p50"), "event_type").groupBy("event_type").agg(
        F.avg((F.col("value") < F.col("p50")).cast("double")).alias("lo"), F.avg((F.col("value") <= F.col("p50")).cast("double")).alias("hi")
    )
    both = stats.join(built, "event_type").join(exact, "event_type")
    ok = (F.col("lo") <= 0.51) & (F.col("hi") >= 0.49)
    return both.select("event_type", "n", "min", "max", ok.alias("median_ok"), (F.col("n") == F.col("n2")).alias("same_as_batch"))
