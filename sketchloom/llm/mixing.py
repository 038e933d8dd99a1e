"""Mixing sources to target weights by Pfair scheduling.

Documents of a source, in a seeded shuffle order, form blocks. Block i of source s is released when the ideal (fluid) schedule
begins it and is due when that schedule has finished it: with all sources live, floor((i - 1) / w) and ceil(i / w) in slots.
Earliest deadline first among released blocks then keeps every source within less than one block of its ideal share at
every slot. When a source is used up, the weights of the others are scaled up, so every document is placed exactly once.

All arithmetic is in integers. In the time v of the fluid schedule in which source s has v * w_s blocks done, slot time is
t(v) = sum over sources of min(K_j, w_j v), so block edges are rationals with denominator w_s.

The slots are cut into slices. At a slice edge the number of blocks that each source has had is its ideal share rounded down
or up (largest remainders first). A slice is at least as long as the smallest weight needs for one block, so these numbers
never fall; between two edges, blocks with their windows clipped to the slice always fit (every interval holds at most as many
blocks as slots), and earliest deadline first finds the order. So slices are scheduled independently, by many tasks.

The weights are a parameter; sources without one (a null source too) share the weight of ``OTHER``. Only one row per
weight comes to the driver. Numbering inside a source is done in hash buckets of about ROWS rows, so a source with a third of
all rows is spread like any other. Repeated rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OTHER = "(other)"
ROWS = 4096
SLICE = 1024


@dataclass(frozen=True)
class Plan:
    """weights and block counts of the live sources, in a fixed order."""

    names: tuple[str, ...]
    weights: tuple[int, ...]
    blocks: tuple[int, ...]

    @property
    def total(self) -> int:
        return sum(self.blocks)

    @property
    def slice_len(self) -> int:
        return max(SLICE, -(-sum(self.weights) // min(self.weights))) if self.names else SLICE

    def tables(self) -> tuple[list[Fraction], list[int], list[int]]:
        """Ends of the sources in fluid time, ascending; blocks of those ended before each; weights of those still live."""
        order = sorted(range(len(self.names)), key=lambda j: Fraction(self.blocks[j], self.weights[j]))
        ends = [Fraction(self.blocks[j], self.weights[j]) for j in order]
        done = [0, *accumulate(self.blocks[j] for j in order)]
        live = [sum(self.weights) - x for x in (0, *accumulate(self.weights[j] for j in order))]
        return ends, done, live

    def edge(self, s: int, i: int, ends, done, live) -> Fraction:
        """Slot time at which the fluid schedule has finished block i of source s."""
        v = Fraction(i, self.weights[s])
        e = bisect_right(ends, v)
        return done[e] + v * live[e]

    def shares(self, t: int, ends, done, live) -> list[int]:
        """Blocks that each source has had at slot t, a slice edge."""
        if t >= self.total:
            return list(self.blocks)
        begins = [done[e] + (ends[e - 1] if e else 0) * live[e] for e in range(len(ends))]
        e = bisect_right(begins, t) - 1
        v = Fraction(t - done[e], 1) / live[e]
        exact = [min(Fraction(k), w * v) for k, w in zip(self.blocks, self.weights, strict=True)]
        got = [x.numerator // x.denominator for x in exact]
        by_rest = sorted(range(len(got)), key=lambda j: (got[j] - exact[j], j))
        for j in by_rest[: t - sum(got)]:
            got[j] += 1
        return got

    def slice_rows(self, k: int) -> list[tuple[str, int, int, int, int]]:
        """(source, block, slot, release, deadline) of slice k; blocks count from 0."""
        a, b = k * self.slice_len, min((k + 1) * self.slice_len, self.total)
        at = self.tables()
        jobs = []
        for s, (lo, hi) in enumerate(zip(self.shares(a, *at), self.shares(b, *at), strict=True)):
            for i in range(lo, hi):
                r, d = self.edge(s, i, *at), self.edge(s, i + 1, *at)
                jobs.append((r.numerator // r.denominator, -(-d.numerator // d.denominator), s, i))
        jobs.sort(key=lambda j: (max(j[0], a), j[1]))
        out, ready, n = [], [], 0
        for slot in range(a, b):
            while n < len(jobs) and max(jobs[n][0], a) <= slot:
                heapq.heappush(ready, (min(jobs[n][1], b), jobs[n][2], jobs[n][3], jobs[n]))
                n += 1
            *_, (r, d, s, i) = heapq.heappop(ready)
            out.append((self.names[s], i, slot, r, d))
        return out


def place(docs: DataFrame, weights: dict[str, int], block: int = 64, seed: int = 7) -> DataFrame:
    """doc_id, k_text, mix_source, block, slot, release, deadline, mix_pos, one row per document. mix_pos = slot * block + place in
    the block: unique and ascending in the mixed order (a source's last block may be short)."""
    if any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are positive integers")
    named = [k for k in weights if k != OTHER]
    source = F.when(F.col("source").isin(named), F.col("source")).otherwise(OTHER)
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", tie.alias("k_text"), source.alias("mix_source")).withColumn(
        "h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("k_text"))
    )
    rows = cut(rows, "mix-rows")
    counts = {r["mix_source"]: r["count"] for r in rows.groupBy("mix_source").count().collect()}  # one row per weight
    names = sorted(counts)
    plan = Plan(tuple(names), tuple(weights.get(n, 1) for n in names), tuple(-(-counts[n] // block) for n in names))
    buckets = F.lit(1)
    for n in names:
        buckets = F.when(F.col("mix_source") == n, max(1, -(-counts[n] // ROWS))).otherwise(buckets)
    rows = rows.withColumn("bucket", F.pmod(F.col("h"), buckets))
    sizes = rows.groupBy("mix_source", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("mix_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("mix_source", "bucket").orderBy("h", "doc_id", "k_text")
    numbered = (
        rows.withColumn("nth", F.row_number().over(inside) - 1)
        .join(offsets, ["mix_source", "bucket"])
        .withColumn("index", F.col("nth") + F.col("offset"))
        .withColumn("block", F.floor(F.col("index") / block))
    )
    slices = -(-plan.total // plan.slice_len)

    def run(batches):
        for b in batches:
            for k in b["id"]:
                yield pd.DataFrame(plan.slice_rows(int(k)), columns=["mix_source", "block", "slot", "release", "deadline"])

    spark = docs.sparkSession
    slots = spark.range(0, slices, 1, max(1, min(slices, 10_000))).mapInPandas(run, "mix_source string, block long, slot long, release long, deadline long")
    return numbered.join(slots, ["mix_source", "block"]).select(
        "doc_id", "k_text", "mix_source", "block", "slot", "release", "deadline", (F.col("slot") * block + F.col("index") % block).alias("mix_pos")
    )


def reorder(docs: DataFrame, weights: dict[str, int], block: int = 64, seed: int = 7) -> DataFrame:
    """docs in mixed order, all rows and columns kept: range-partitioned by mix_pos and sorted, so files written from it follow
    the schedule. Rows equal in id and text are interchangeable, so places are dealt to them by number."""
    cols = docs.columns
    same = Window.partitionBy("k_id", "k_text").orderBy("mix_pos")
    k_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k_id")
    places = place(docs, weights, block, seed).select(k_id, "k_text", "mix_pos")
    places = places.withColumn("copy", F.row_number().over(same))
    rows = docs.select(F.struct(*cols).alias("row"), k_id, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k_text"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("k_id", "k_text").orderBy("k_text")))
    placed = rows.join(places, ["k_id", "k_text", "copy"]).select("row", "mix_pos")
    return placed.repartitionByRange("mix_pos").sortWithinPartitions("mix_pos").select("row.*")


#: Parts of the mix; sources not named share the last.
WEIGHTS = {"src0": 15, "src1": 10, "src2": 10, "src3": 8, "src4": 8, "src5": 6, OTHER: 43}


def mixing_report(docs: DataFrame) -> DataFrame:
    """The columns of query op4."""
    return place(docs, WEIGHTS).drop("k_text")
