"""Summaries over Structured Streaming: event-time windows of native states, and per-key states of our own.

Window aggregates keep one bounded binary state per open window and key; the watermark closes windows and drops late rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.hashing import FAST, Hasher
from ..functions.spec import SampleSpec, TDigestSpec
from ..operators.quantiles import TDigest


def windowed(stream: DataFrame, ts: str, size: str, late: str, aggs: dict[str, Column], keys: list[str] = (), slide: str | None = None) -> DataFrame:
    """keys.., start, end and the aggregates per event-time window. late: how long a window stays open after its end."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    grouped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def sessions(stream: DataFrame, ts: str, gap: str, late: str, aggs: dict[str, Column], keys: list[str]) -> DataFrame:
    grouped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*[a.alias(n) for n, a in aggs.items()])
    return grouped.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *aggs)


def distinct_state(item: str, lg_k: int = 12) -> Column:
    """An HLL state; windows merge with hll_union_agg."""
    return F.hll_sketch_agg(item, lg_k)


def theta_state(item: str, lg_k: int = 12) -> Column:
    return F.theta_sketch_agg(item, lg_k)


def kll_state(value: str, k: int = 200) -> Column:
    return F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k))


def digest_states(stream: DataFrame, keys: list[str], value: str, spec: TDigestSpec = TDigestSpec()) -> DataFrame:
    """keys.., n, sketch per trigger (update mode): the digest of all rows so far, as tdigest_build stores it, so its quantiles, ranks and statistics are asked
    and states of several streams merge as any other. A micro-batch is the buffer that is folded in."""
    types = ", ".join([*(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys), "n long, sketch binary"])

    def fold(key, batches, state: GroupState):
        digest = TDigest.from_bytes(bytes(state.get[0])) if state.exists else TDigest(spec)
        for b in batches:
            digest.add(b[value].dropna().to_numpy(dtype=float))
        data = digest.to_bytes()
        state.update((data,))
        yield pd.DataFrame([(*key, digest.n, data)], columns=[*keys, "n", "sketch"])

    return stream.groupBy(*keys).applyInPandasWithState(fold, types, "sketch binary", "update", GroupStateTimeout.NoTimeout)


def digest_stream(stream: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], spec: TDigestSpec = TDigestSpec()) -> DataFrame:
    """keys.., n and quantiles per trigger (update mode): the state of a key is its digest; a micro-batch is the buffer that is folded in."""
    types = ", ".join([*(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys), "n long", *(f"`{q}` double" for q in quantiles)])

    def fold(key, batches, state: GroupState):
        digest = TDigest.from_bytes(bytes(state.get[0])) if state.exists else TDigest(spec)
        for b in batches:
            digest.add(b[value].dropna().to_numpy(dtype=float))
        state.update((digest.to_bytes(),))
        yield pd.DataFrame([(*key, digest.n, *(digest.quantile(q) for q in quantiles.values()))], columns=[*keys, "n", *quantiles])

    return stream.groupBy(*keys).applyInPandasWithState(fold, types, "sketch binary", "update", GroupStateTimeout.NoTimeout)


def sample_stream(stream: DataFrame, keys: list[str], item: str, spec: SampleSpec, seed: int = 0, hasher: Hasher = FAST) -> DataFrame:
    """keys.., item, sample_hash, items_seen, is_full per trigger (update mode): the k smallest hashes so far. Equal to the batch sample of all rows seen; an item that
    comes again changes nothing but items_seen."""
    types = ", ".join([*(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys), "item string", "sample_hash long", "items_seen long", "is_full boolean"])
    rows = stream.where(F.col(item).isNotNull()).select(*keys, F.col(item).cast("string").alias("item"), hasher.h60(item, f"{seed}:").alias("sample_hash"))

    def fold(key, batches, state: GroupState):
        items, hashes, seen = state.get if state.exists else ([], [], 0)
        kept = dict(zip(items, hashes, strict=True))
        for b in batches:
            seen += len(b)
            kept.update(zip(b["item"], b["sample_hash"].astype(int), strict=True))
            kept = dict(sorted(kept.items(), key=lambda x: (x[1], x[0]))[: spec.k])
        state.update((list(kept), [int(h) for h in kept.values()], seen))
        yield pd.DataFrame([(*key, i, h, seen, len(kept) == spec.k) for i, h in kept.items()], columns=[*keys, "item", "sample_hash", "items_seen", "is_full"])

    return rows.groupBy(*keys).applyInPandasWithState(fold, types, "items array<string>, hashes array<long>, seen long", "update", GroupStateTimeout.NoTimeout)


def into_table(path: str, key: str = "batch") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: what each trigger emits as Parquet under its batch id, so a repeated batch overwrites itself and nothing comes to the driver."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{key}={batch_id}")

    return write


def into_state(path: str, build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch's state table under its batch id, so a repeated batch overwrites itself; states merge on reading by the
    family's combine."""

    def write(batch: DataFrame, batch_id: int) -> None:
        build(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
