"""Stored states, SQL functions, sequential estimators and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions.hashing import PORTABLE
from sketchloom.functions.register import register
from sketchloom.functions.spec import CpcSpec, HllSpec, MatrixSpec, SampleSpec
from sketchloom.operators import cardinality as c
from sketchloom.operators import sampling as s
from sketchloom.operators.sequential import ConservativeCountMin, HipCpc, HipHll
from sketchloom.sources.codec import CodecError, read_state, write_state
from sketchloom.sources.tables import delimited
from sketchloom.streaming import summaries as m


def integers(n):
    return (i.to_bytes(8, "little") for i in range(n))


def test_golden_values():
    """Published estimates for the integers below a million."""
    assert HipHll(HllSpec(12)).update(integers(1_000_000)).estimate() == pytest.approx(993466.885291, abs=1e-4)
    cpc = HipCpc(CpcSpec(12)).update(integers(1_000_000))
    assert cpc.estimate() == pytest.approx(1003398.339822, abs=1e-4) and len(cpc.coupons) == 33_926


def test_conservative_count_min():
    table, counts = ConservativeCountMin(MatrixSpec(64, 4)), {}
    for x in np.random.default_rng(1).zipf(1.5, 2000) % 300:
        table.update(str(x).encode())
        counts[x] = counts.get(x, 0) + 1
    assert all(table.estimate(str(k).encode()) >= n for k, n in counts.items())


def test_stored_state(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("v"))
    path = str(tmp_path / "hll")
    write_state(c.hll_build(df, "v", []), path, "hll", {"p": 12})
    assert c.hll_estimate(read_state(spark, path, "hll", {"p": 12}), []).first()[0] == c.hll_estimate(c.hll_build(df, "v", []), []).first()[0]
    for family, parameters in (("hll", {"p": 13}), ("cpc", {"p": 12})):
        with pytest.raises(CodecError):
            read_state(spark, path, family, parameters)


def test_sql_functions(spark):
    register(spark)
    spark.range(5000).select(F.col("id").cast("string").alias("v"), F.col("id").cast("double").alias("x")).createOrReplaceTempView("items")
    rows = spark.sql("select hll_index(h60(v), 12) as idx, max(hll_rank(h60(v), 12)) as rank from items group by 1")
    built = c.hll_build(spark.table("items"), "v", [], hasher=PORTABLE)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, built.collect()))
    got = spark.sql("select tdigest_quantile(tdigest_agg(x), 0.5D) as a, req_quantile(req_agg(x), 0.99D) as b, tdigest_rank(tdigest_agg(x), 2500D) as r from items").first()
    assert abs(got["a"] - 2500) < 50 and abs(got["b"] - 4950) < 10 and abs(got["r"] - 0.5) < 0.02


def test_delimiters(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|2\n3|4\n")
    assert [tuple(r) for r in delimited(spark, str(tmp_path / "a.csv"), "x int, y int").collect()] == [(1, 2), (3, 4)]


@pytest.fixture
def events(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(4).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def finish(stream, name, mode):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def test_stream_windows_equal_batch(spark, events):
    stream, batch = events
    out = m.windowed(stream, "ts", "1 day", "40 days", {"state": m.distinct_state("user_id"), "n": F.count(F.lit(1))}, ["event_type"])
    finish(out.select("event_type", "start", F.hll_sketch_estimate("state").alias("users"), "n"), "windows", "update")
    last = spark.table("windows").groupBy("event_type", "start").agg(F.max("n").alias("n"), F.max("users").alias("users"))
    direct = batch.groupBy("event_type", F.window("ts", "1 day").start.alias("start")).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 12)).alias("users"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, direct.select(last.columns).collect()))


def test_stream_sample_equals_batch(spark, events):
    stream, batch = events
    finish(m.sample_stream(stream, ["event_type"], "event_id", SampleSpec(20), seed=3), "samples", "update")
    rows = spark.table("samples").select("event_type", "item", "sample_hash").distinct()
    seen = spark.createDataFrame(rows.collect(), rows.schema)
    kept = s.uniform_sample_by(seen.select("event_type", F.col("item").alias("event_id")), ["event_type"], "event_id", SampleSpec(20), seed=3)
    direct = s.uniform_sample_by(batch.select("event_type", F.col("event_id").cast("string").alias("event_id")), ["event_type"], "event_id", SampleSpec(20), seed=3)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, direct.collect()))


def test_stream_digest(spark, events):
    stream, batch = events
    finish(m.digest_stream(stream, ["event_type"], "value", {"p50": 0.5}), "digests", "update")
    last = spark.table("digests").groupBy("event_type").agg(F.max_by("p50", "n").alias("p50"), F.max("n").alias("n"))
    exact = batch.groupBy("event_type").agg(F.percentile("value", 0.5).alias("true"), F.count(F.lit(1)).alias("rows"))
    for r in last.join(exact, "event_type").collect():
        assert r["n"] == r["rows"] and abs(r["p50"] - r["true"]) <= 0.15 * abs(r["true"]) + 0.5


def test_foreach_batch_state(spark, events, tmp_path):
    stream, batch = events
    path = str(tmp_path / "state")
    query = stream.writeStream.foreachBatch(m.into_state(path, lambda d: c.hll_build(d, "user_id", []))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    merged = c.hll_combine(spark.read.parquet(path).select("idx", "rank"), [])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, c.hll_build(batch, "user_id", []).collect()))
