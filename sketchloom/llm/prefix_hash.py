"""Document fingerprints from prefix polynomial hashes.

A text of code points c has, for modulus p and base x, the prefix array P[i] = sum of (c[j] + 1) x^j for j < i (mod p). The hash of the span
[i, i + n) is (P[i + n] - P[i]) x^(-i), so any two spans of any two texts compare in constant time, and the longest
common extension of two places is found by binary search. All spans of ``WINDOW`` code points are hashed from the array at once; the fingerprint is
the whole text's hash and the ``KEPT`` smallest mixed window hashes, from which the likeness of two texts is estimated (Dice
coefficient of their window sets). Fingerprints depend on the text alone.

A null text counts as empty: no windows, likeness 1 to another empty text and 0 to all others. A text shorter than a
window is one window.

The next document (ascending doc_id, null first; rows of one doc_id by text; after the last comes the first) is found without
a global sort: ids are cut into ranges at approximate quantiles, each range's first row is also sent to the range before it, and every
range is read in order, one row ahead. Texts are shuffled once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_of

WINDOW = 24
KEPT = 64
LIMIT = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)

#: (modulus 2^31 - 1, base) of the two arrays.
PRIME = np.uint64(2**31 - 1)
BASES = (1_103_515_245, 69_069_013)
INVERSES = tuple(pow(b, -1, 2**31 - 1) for b in BASES)
_powers: dict[int, np.ndarray] = {}


def fold(x: np.ndarray) -> np.ndarray:
    """x mod 2^31 - 1, for products of two values below the modulus and for smaller x (unsigned wrap-around picks the lesser)."""
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.minimum(x, x - PRIME)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1) at least, doubled as needed."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        step = fold(have[-1:] * np.uint64(base))
        have = np.concatenate([have, fold(have * step)])
    _powers[base] = have
    return have


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(self.points)
        self.sums: dict[int, np.ndarray] = {}

    def prefix(self, which: int) -> np.ndarray:
        if which not in self.sums:
            out = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(fold(self.points * powers(BASES[which], self.n)[: self.n]), out=out[1:])
            self.sums[which] = fold(out)
        return self.sums[which]

    def spans(self, which: int, begin: int, end: int, length: int) -> np.ndarray:
        """Hashes of the spans of one length that begin at begin to end - 1; they depend on the spans' contents alone."""
        p = self.prefix(which)
        parts = p[begin + length : end + length] + PRIME - p[begin:end]
        return fold(fold(parts) * powers(INVERSES[which], end)[begin:end])

    def span(self, i: int, length: int) -> tuple[int, int]:
        """Both hashes of one span."""
        m, p, q = 2**31 - 1, self.prefix(0), self.prefix(1)
        x, y = int(p[i + length]) - int(p[i]), int(q[i + length]) - int(q[i])
        return x * pow(INVERSES[0], i, m) % m, y * pow(INVERSES[1], i, m) % m


def same_span(a: PrefixHash, i: int, b: PrefixHash, j: int, length: int) -> bool:
    return a.span(i, length) == b.span(j, length)


def common_extension(a: PrefixHash, i: int, b: PrefixHash, j: int) -> int:
    """Length of the longest equal spans that begin at a[i] and b[j]."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        if same_span(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


def smallest(h: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values of 32 bits, ascending."""
    if len(h) > 8 * k:
        some = np.unique(h[h < np.uint64((4 * k << 32) // len(h))])
        if len(some) >= k:
            return some[:k]
    return np.unique(h)[:k]


def windows(p: PrefixHash, begin: int, end: int, width: int = WINDOW) -> np.ndarray:
    """KEPT smallest mixed hashes of the windows that begin at begin to end - 1."""
    kept = np.zeros(0, dtype=np.uint64)
    for at in range(begin, end, LIMIT):
        h = p.spans(0, at, min(at + LIMIT, end), width)
        kept = smallest(np.concatenate([kept, (h * MIX) >> np.uint64(32)]), KEPT)
    return kept


def joined(*parts: np.ndarray) -> np.ndarray:
    return smallest(np.concatenate(parts), KEPT)


def said(whole: tuple[int, int], sketch: np.ndarray) -> str:
    return f"{whole[0]:08x}{whole[1]:08x}-" + sketch.astype(">u4").tobytes().hex()


def fingerprint(p: PrefixHash) -> tuple[str, np.ndarray]:
    width = min(WINDOW, p.n)
    sketch = windows(p, 0, p.n - width + 1, width) if p.n else np.zeros(0, dtype=np.uint64)
    return said(p.span(0, p.n), sketch), sketch


def edited_fingerprint(text: str, p: PrefixHash, put: str) -> tuple[str, str, np.ndarray, int]:
    """The text with its last floor(n / 2) code points replaced by ``put``: that text, its fingerprint, its sketch, and the longest
    common prefix with the text. The kept half is not hashed again: spans of the text's own arrays serve."""
    keep = p.n - p.n // 2
    edited, q = text[:keep] + put, PrefixHash(put)
    common = keep + common_extension(p, keep, q, 0)
    if min(keep, q.n) < WINDOW:
        return edited, *fingerprint(PrefixHash(edited)), common
    m = 2**31 - 1
    whole = tuple((a + pow(b, keep, m) * c) % m for a, b, c in zip(p.span(0, keep), BASES, q.span(0, q.n), strict=True))
    seam = PrefixHash(text[keep - WINDOW + 1 : keep] + put[: WINDOW - 1])
    sketch = joined(windows(p, 0, keep - WINDOW + 1), windows(seam, 0, WINDOW - 1), windows(q, 0, q.n - WINDOW + 1))
    return edited, said(whole, sketch), sketch, common


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of the window sets, estimated from the smallest hashes of their union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:KEPT]
    shared = np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)
    part = shared.sum() / len(both)
    return float(2 * part / (1 + part))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint, one row per document; two fingerprints compare by ``likeness`` of ``kept_hashes``."""

    def run(batches):
        with np.errstate(over="ignore"):
            for b in slices_of(batches, 4_000_000):
                made = [PrefixHash(t or "") for t in b.column("text").to_pylist()]
                cols = [b.column("doc_id").cast(pa.int64()), pa.array([p.n for p in made], pa.int64()), pa.array([fingerprint(p)[0] for p in made], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def kept_hashes(mark: str) -> np.ndarray:
    """The window hashes in a fingerprint."""
    return np.frombuffer(bytes.fromhex(mark.partition("-")[2]), dtype=">u4").astype(np.uint64)


def in_id_ranges(docs: DataFrame) -> DataFrame:
    """(range, look, doc_id, text): rows dealt to ranges of doc_id; look = 1: a copy of the first row of the following range."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"))
    n = max(32, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = np.unique(np.array(rows.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n), dtype=np.float64))

    def ranges(keys: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, keys.to_numpy().astype(np.float64), side="right")

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(ranges(keys), dtype="int32")

    firsts = sorted((r["range"], r["first"]) for r in rows.select("key").groupBy(range_of("key").alias("range")).agg(F.min("key").alias("first")).collect())
    before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}  # one row per range; before the first comes the last

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        return pd.Series([[2 * r, 2 * before[k] + 1] if k in before else [2 * r] for r, k in zip(ranges(keys).tolist(), keys.tolist(), strict=True)])

    dealt = rows.withColumn("place", F.explode(places("key")))
    return dealt.select(F.shiftright("place", 1).alias("range"), F.col("place").bitwiseAND(1).alias("look"), "key", "doc_id", "text").repartition("range").sortWithinPartitions(
        "range", "look", "key", "text"
    )


DIGEST = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64()),
    ]
)


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op7, and common_prefix: the longest common extension of a text and its edited text from their start."""

    class Doc:
        def __init__(self, doc_id, text):
            self.doc_id, self.text = doc_id, text or ""
            self.hash = PrefixHash(self.text)
            self.mark, self.sketch = fingerprint(self.hash)

    def row(d: Doc, nxt: Doc) -> tuple:
        n = d.hash.n
        edited, mark, sketch, common = edited_fingerprint(d.text, d.hash, nxt.text[: n // 2])
        near = likeness(d.sketch, sketch), likeness(d.sketch, nxt.sketch)
        return (d.doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), d.mark, mark, *near, common)

    def run(batches):
        held, at = None, None
        with np.errstate(over="ignore"):
            for b in batches:
                out = []
                for rng, look, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "look", "doc_id", "text")), strict=True):
                    if rng != at:
                        held, at = None, rng
                    if look and held is None:
                        continue
                    doc = Doc(doc_id, text)
                    if held is not None:
                        out.append(row(held, doc))
                    held = None if look else doc
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), DIGEST, strict=True)], schema=DIGEST)

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return in_id_ranges(docs).select("range", "look", "doc_id", "text").mapInArrow(run, kinds)
