"""Frequencies: Count-Min and Count Sketch matrices as state tables, frequent items by mergeable Misra-Gries summaries.

Matrices are linear: building is an aggregation per (row, column) after items are counted (so a hot item is one row per task), merging is a
union and a sum. Point queries join the question's cells with the state.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import FAST, Hasher
from ..functions.spec import FrequentSpec, MatrixSpec, require
from .cardinality import d


def _counted(df: DataFrame, item: str, keys: list[str], weight: str | Column | None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight) if isinstance(weight, str) else weight)
    return df.where(F.col(item).isNotNull()).groupBy(*keys, F.col(item).cast("string").alias("_item")).agg(n.alias("_n"))


def _cells(item: str, spec: MatrixSpec, hasher: Hasher, signed: bool) -> Column:
    """array<struct<row, col, sign>> of an item."""
    rows = []
    for r, h in enumerate(hasher.parts(item, spec.depth)):
        sign = (F.lit(1) - 2 * h.bitwiseAND(1)).cast("int") if signed else F.lit(1)  # the last bit, and the others choose the column
        col = (F.shiftright(h, 1) if signed else h) % spec.width
        rows.append(F.struct(F.lit(r).alias("row"), col.cast("int").alias("col"), sign.alias("sign")))
    return F.explode(F.array(*rows))


def matrix_build(
    df: DataFrame, item: str, keys: list[str], spec: MatrixSpec, weight: str | Column | None = None, signed: bool = False, hasher: Hasher = FAST
) -> DataFrame:
    """(keys.., row, col, n). signed: Count Sketch; else Count-Min."""
    counted = _counted(df, item, keys, weight)
    cells = counted.select(*keys, "_n", _cells("_item", spec, hasher, signed).alias("c"))
    return cells.groupBy(*keys, F.col("c.row").alias("row"), F.col("c.col").alias("col")).agg(F.sum(F.col("_n") * F.col("c.sign")).alias("n"))


def matrix_merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "row", "col").agg(F.sum("n").alias("n"))


def matrix_query(state: DataFrame, questions: DataFrame, item: str, spec: MatrixSpec, signed: bool = False, hasher: Hasher = FAST) -> DataFrame:
    """The distinct items of ``questions`` with their estimate: the least cell, or for signed cells the upper median."""
    asked = questions.select(F.col(item)).where(F.col(item).isNotNull()).distinct().withColumn("_item", F.col(item).cast("string"))
    cells = asked.select(F.col(item), _cells("_item", spec, hasher, signed).alias("c")).select(item, "c.*")
    found = cells.join(state, ["row", "col"], "left")
    value = F.coalesce("n", F.lit(0)) * F.col("sign")
    if not signed:
        return found.groupBy(item).agg(F.min(value).alias("estimate"))
    return found.groupBy(item).agg(F.element_at(F.array_sort(F.collect_list(value)), spec.depth // 2 + 1).alias("estimate"))  # depth values


def matrix_statistics(state: DataFrame, spec: MatrixSpec) -> DataFrame:
    """width, depth, total_cells, non_zero_cells, fill_ratio, total_count (least row sum), max_count, min_count."""
    rows = state.groupBy("row").agg(F.sum("n").alias("s"), F.count_if(F.col("n") != 0).alias("c"), F.max("n").alias("hi"), F.min("n").alias("lo"))
    cells = spec.width * spec.depth
    used = F.sum("c")
    return rows.agg(
        F.lit(spec.width).cast("bigint").alias("width"), F.lit(spec.depth).cast("bigint").alias("depth"), F.lit(cells).cast("bigint").alias("total_cells"), used.alias("non_zero_cells"),
        (used.cast("double") / d(cells)).alias("fill_ratio"), F.min("s").alias("total_count"), F.max("hi").alias("max_count"),
        F.when(used == cells, F.min("lo")).otherwise(F.lit(0).cast("bigint")).alias("min_count"),
    )


def heavy_cells(state: DataFrame, threshold: int) -> DataFrame:
    """n: the distinct cell counts of at least the threshold."""
    return state.where(F.col("n") >= threshold).select("n").distinct()


def heavy_items(df: DataFrame, item: str, state: DataFrame, threshold: int, spec: MatrixSpec, hasher: Hasher = FAST) -> DataFrame:
    """Items whose estimate is at least the threshold (never misses one; Count-Min does not under-estimate)."""
    return matrix_query(state, df, item, spec, hasher=hasher).where(F.col("estimate") >= threshold)


def conservative_update(cells: list[int], count: int) -> list[int]:
    """One conservative update of an item's cells: each is raised to the old minimum plus the count. Depends on the order of updates, so it is
    offered for a single stream only."""
    goal = min(cells) + count
    return [max(c, goal) for c in cells]


#: Summaries that one task merges.
FAN_IN = 64

# -- frequent items -------------------------------------------------------------------------------------------------------


def trim(counts: dict[str, int], size: int) -> tuple[dict[str, int], int]:
    """At most ``size`` counters: the (size + 1)-th largest count is taken off all (Misra-Gries); returns them and what was taken off."""
    if len(counts) <= size:
        return counts, 0
    cut = heapq.nlargest(size + 1, counts.values())[-1]
    return {k: v - cut for k, v in counts.items() if v > cut}, cut


def frequent_build(df: DataFrame, item: str, spec: FrequentSpec, weight: str | None = None) -> DataFrame:
    """(item, n, offset, total): a Misra-Gries summary. Rows are counted by item first (combined before the shuffle); tasks summarise the counts as
    they stream by, at most max_map_size counters each; rounds of merges, FAN_IN summaries a task, bring these down to one.
    n <= true count <= n + offset."""
    size = spec.max_map_size
    kinds = "part long, item string, n long, cut long, total long"

    def rows(counts: dict[str, int], cut: int, total: int, part: int = 0) -> pd.DataFrame:
        items = [*counts.items()] or [(None, 0)]
        frame = pd.DataFrame(items, columns=["item", "n"])
        frame.insert(0, "part", part)
        frame["cut"] = [cut] + [0] * (len(items) - 1)
        frame["total"] = [total] + [0] * (len(items) - 1)
        return frame

    def local(batches):
        from pyspark import TaskContext

        counts, off, total = {}, 0, 0
        for b in batches:
            sums = b.groupby("item", sort=False)["n"].sum()
            total += int(sums.sum())
            for k, v in sums.items():
                counts[k] = counts.get(k, 0) + int(v)
            if len(counts) > 4 * size:
                counts, cut = trim(counts, size)
                off += cut
        counts, cut = trim(counts, size)
        if total:
            yield rows(counts, off + cut, total, TaskContext.get().partitionId())

    def merged(groups: int):
        def merge(b: pd.DataFrame) -> pd.DataFrame:
            sums = b.dropna(subset=["item"]).groupby("item")["n"].sum()
            counts, cut = trim({k: int(v) for k, v in sums.items()}, size)
            return rows(counts, int(b["cut"].sum()) + cut, int(b["total"].sum()), int(b["part"].iloc[0]) % groups)

        return merge

    counted = _counted(df, item, [], None if weight is None else F.col(weight).cast("long"))
    parts = counted.select(F.col("_item").alias("item"), F.col("_n").alias("n")).mapInPandas(local, kinds)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while tasks > 1:  # summaries of bounded size, FAN_IN of them in a task
        tasks = -(-tasks // FAN_IN)
        parts = parts.groupBy((F.col("part") % tasks).alias("g")).applyInPandas(merged(tasks), kinds)
    total = F.sum("cut").over(_all()), F.sum("total").over(_all())
    return parts.select("item", "n", total[0].alias("offset"), total[1].alias("total")).where("item is not null")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # one summary: at most max_map_size rows


def frequent_items(summary: DataFrame, threshold: int | None = None, fraction: float | None = None, no_false_positives: bool = False) -> DataFrame:
    """item, estimate, lower, upper of items whose lower (or upper) bound is over the threshold or over floor(fraction * total)."""
    require((threshold is None) != (fraction is None), "give a threshold or a fraction")
    limit = F.lit(threshold) if fraction is None else F.floor(d(fraction) * F.col("total"))
    bound = F.col("n") if no_false_positives else F.col("n") + F.col("offset")
    return summary.where(bound > limit).select("item", F.col("n").alias("estimate"), F.col("n").alias("lower"), (F.col("n") + F.col("offset")).alias("upper"))


def frequent_merge(a: DataFrame, b: DataFrame, spec: FrequentSpec) -> DataFrame:
    """Summary of both summaries' streams: counts add up, then the (max_map_size + 1)-th largest is taken off all. At most twice max_map_size rows."""
    from pyspark.sql import Window

    both = a.unionByName(b).groupBy("item").agg(F.sum("n").alias("n"))
    heads = [s.agg(F.coalesce(F.max("offset"), F.lit(0)).alias("offset"), F.coalesce(F.max("total"), F.lit(0)).alias("total")) for s in (a, b)]
    ends = heads[0].unionByName(heads[1]).agg(F.sum("offset").alias("offset"), F.sum("total").alias("total"))
    ranked = both.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("n"), "item")))
    cut = F.coalesce(F.max(F.when(F.col("_r") == spec.max_map_size + 1, F.col("n"))).over(_all()), F.lit(0))
    kept = ranked.withColumn("_cut", cut).where(F.col("n") > F.col("_cut")).crossJoin(F.broadcast(ends))  # one row
    return kept.select("item", (F.col("n") - F.col("_cut")).alias("n"), (F.col("offset") + F.col("_cut")).alias("offset"), "total")


def frequent_bounds(summary: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """The distinct items asked for with estimate, lower and upper; an item that is not kept has at most the offset."""
    asked = items.select(F.col(item).cast("string").alias("item")).where("item is not null").distinct()
    offset = summary.agg(F.coalesce(F.max("offset"), F.lit(0)).alias("_off"))
    found = asked.join(summary.select("item", "n"), "item", "left").crossJoin(F.broadcast(offset))  # one row
    n = F.coalesce("n", F.lit(0))
    return found.select("item", n.alias("estimate"), n.alias("lower"), (n + F.col("_off")).alias("upper"))


def frequent_statistics(summary: DataFrame, spec: FrequentSpec) -> DataFrame:
    return summary.agg(
        F.lit(spec.max_map_size).cast("bigint").alias("max_map_size"), F.count(F.lit(1)).alias("current_map_size"), F.coalesce(F.max("total"), F.lit(0)).alias("stream_length"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_tracked_frequency"), F.coalesce(F.max("offset"), F.lit(0)).alias("offset"),
    )


def top_k(summary: DataFrame, k: int) -> DataFrame:
    return frequent_items(summary, threshold=-1).orderBy(F.desc("estimate"), "item").limit(k)


def exact_top_k(df: DataFrame, item: str, k: int) -> DataFrame:
    """item, n: the k most frequent (ties by item); a partial aggregation and a top-k per task before anything is gathered."""
    return _counted(df, item, [], None).select(F.col("_item").alias("item"), F.col("_n").alias("n")).orderBy(F.desc("n"), "item").limit(k)
