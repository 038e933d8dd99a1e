"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant within r/2 bits of both. Every distinct fingerprint emits all its variants
within half the radius; the variants are shuffled, and those that meet at one variant are linked. With an even radius all
members of a variant are within r of each other, so linking each with the smallest of them keeps every connection and no
pairs are spelled out; a variant has at most C(64, r/2) + ... distinct members (65 for radius 2), whatever the number of
copies. Links are verified bit by bit. Components come from repeated minimum labels with pointer jumping, each round written
to the shared folder.

Fingerprints of 64 bits are too coarse to find all pairs of a given similarity; ``near_copies`` completes them for that.

Equal texts fall together before anything is joined: a class is a distinct fingerprint with its smallest doc_id. A null text
counts as empty; a text without words has fingerprint zero and is linked like any other. A null doc_id counts in its class
but never names a component unless all ids there are null.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, slices_of

SEED = 42
ROUNDS = 64
UNPACKED = 100_000
SLICE = 2_000_000


def simhash(text: str | None, width: int = 3) -> int:
    """64-bit fingerprint of the shingles of ``width`` words, repeats included: a bit is set if over half the hashes have it."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]  # noqa: B905
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype=np.dtype("<u8"), count=n))


def majority(hashes: np.ndarray) -> int:
    """The 64 bits of which each is set in over half the hashes; none of no hashes. Bits are unpacked in blocks, so memory is bounded."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), UNPACKED):
        part = np.ascontiguousarray(hashes[i : i + UNPACKED]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The key columns (longs) and fp (the 64 bits as a signed long), one row per document."""

    def run(batches):
        for b in slices_of(batches, SLICE):
            fp = np.array([simhash(t, width) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k).cast(pa.int64()) for k in keys), pa.array(fp)], [*keys, "fp"])

    return docs.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "fp")))


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks of at most half the radius bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b), a > b: verified links between distinct fingerprints in column fp, enough to keep every connection."""
    if radius % 2:
        raise ValueError("the radius must be even")
    variant = F.explode(F.transform(F.array(*map(F.lit, ball_masks(radius))), lambda m: F.col("fp").bitwiseXOR(m)))
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row becomes many: spread them first
    met = classes.select("fp").repartition(n, "fp").select("fp", variant.alias("variant")).groupBy("variant").agg(F.collect_list("fp").alias("fps"))
    star = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
    return star.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node can reach. ``edges`` (a, b) are read in both directions.

    A round gives every node the smallest label among itself and its neighbours, then its label's label, and draws the edges between labels
    anew without those that became loops or repeats. At least half of the nodes with edges are gone after a round, and the rows of later joins with them."""
    label_of = None
    edges = cut(edges.select("a", "b").distinct(), "edges")
    for i in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), f"near{i}")
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("next"))
        best = cut(near.join(jump, "label").select("node", F.least("label", "next").alias("label")), f"best{i}")
        if label_of is None:
            spent, label_of = [near], best
        else:
            fresh = best.select(F.col("node").alias("label"), F.col("label").alias("next"))
            spent, label_of = [near, best, label_of], cut(label_of.join(fresh, "label", "left").select("node", F.coalesce("next", "label").alias("label")), f"label{i}")
        left, right = (best.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label")) for k in ("a", "b"))
        drawn = edges.join(left, "a").join(right, "b").where("a_label <> b_label")
        spent, edges = [*spent, edges], cut(drawn.select(F.greatest("a_label", "b_label").alias("a"), F.least("a_label", "b_label").alias("b")).distinct(), f"edges{i}")
        drop(*spent)
        if edges.isEmpty():
            drop(edges)
            return label_of
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def class_labels(classes: DataFrame, radius: int = 2) -> DataFrame:
    """classes (distinct fp, other columns) with label: the smallest fp that each can reach."""
    labels = components(links(classes, radius))
    return classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id, one row per document."""
    marked = cut(fingerprints(docs, width), "simhash")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = class_labels(classes, radius)
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = linked.join(smallest, "label").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op8."""
    return near_duplicates(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
