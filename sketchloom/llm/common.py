"""What the operators of this subpackage share: input tables, durable cuts of the lineage, batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: nothing upstream is ever computed again,
    and the loss of an executor costs only the tasks that it ran."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.cut_path = path
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing will read again."""
    for t in tables:
        spark, path = t.sparkSession, getattr(t, "cut_path", None)
        if path and hasattr(spark, "_jvm"):
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def release(*tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing will read again. Shuffle files of ended jobs go when the driver's garbage is collected, which a driver
    with much memory may do late, so it is asked to. Without tables only that."""
    drop(*tables)
    give_back()
    spark = SparkSession.getActiveSession()
    if spark is not None and hasattr(spark, "_jvm"):
        spark._jvm.System.gc()


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(col, UPPER, UPPER.lower())


def text_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that tell rows apart: the id (null: the smallest long) and a hash of the whole text. Rows equal in both
    hold the same text, so every result that depends on the text alone is the same for them."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k_id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k_text"),
    ]


def slices_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes add up to about limit at most (a larger item stands alone)."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def slices_of(batches, limit: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text at most (a longer text stands alone), so that what Python holds at once is bounded."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for lo, hi in slices_by_bytes([n + 64 for n in sizes], limit):
            yield b.slice(lo, hi - lo)
    give_back()


def give_back() -> None:
    """Hands freed memory back to the system: workers live on beside those of later stages, and so does the driver after a fit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def flat_bytes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each item begins (one more entry for the end)."""
    starts = np.zeros(len(blobs) + 1, dtype=np.int64)
    np.cumsum([len(b) for b in blobs], out=starts[1:])
    return np.frombuffer(b"".join(blobs), dtype=np.uint8), starts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: dict[int, int]) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of labelled rows: of each class the per_class[c] smallest hashes of doc_id, none from the held-out
    rows (crc32 of doc_id as text, mod modulus). At most sum(per_class) ids are broadcast and as many rows come to the driver. An id that is labelled both ways is
    left out; of several texts under one id the one with the smallest hash is taken, so the sample is the same in every run."""
    usable = labels.where(f"{label} is not null and doc_id is not null").where(F.col(label).isin(list(per_class))).where(fold_of(modulus) != held_out)
    sure = usable.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("doc_id", F.col("y").cast("int").alias("y"))
    picked = None
    for c, n in sorted(per_class.items()):
        part = sure.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = found.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64(text), text.alias("text")))["text"].alias("text")).collect()
    return [(r["text"] or "", r["y"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def fold_of(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60.0, 60.0)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x) by Newton steps on a lightly penalised likelihood (Platt's smoothed targets)."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design, w = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(steps):
        p = sigmoid(design @ w)
        gradient = design.T @ (p - t) + ridge * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + (ridge + 1e-9) * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])
