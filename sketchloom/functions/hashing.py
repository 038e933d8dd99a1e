"""Hashes for state tables.

``portable``: the first 15 hex digits of the md5 of the item's text, a 60-bit non-negative integer that any SQL engine can recompute.
``fast`` (what operators use unless told otherwise): xxhash64 cut to 60 bits, inside code generation and several times cheaper; only Spark has it.
``murmur3``: two 32-bit murmur3 hashes put together, also inside code generation.

A null item hashes to null and is skipped by every operator, as count(distinct) does. Doubles are hashed by their text, so
NaN is an item of its own and differs from 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60
SPAN = float(2**BITS)


def as_column(item: str | Column) -> Column:
    return F.col(item) if isinstance(item, str) else item


@dataclass(frozen=True)
class Hasher:
    kind: str = "portable"

    def __post_init__(self):
        if self.kind not in ("portable", "fast", "murmur3"):
            raise ValueError(f"unknown hasher {self.kind!r}")

    def h60(self, item: str | Column, salt: str | Column = "") -> Column:
        """60-bit hash of the item's text after the salt."""
        text = as_column(item).cast("string")
        if isinstance(salt, Column) or salt:
            text = F.concat(salt if isinstance(salt, Column) else F.lit(salt), text)
        if self.kind == "fast":
            return F.when(text.isNotNull(), F.shiftrightunsigned(F.xxhash64(text), 64 - BITS))
        if self.kind == "murmur3":
            high, low = (F.hash(t).cast("bigint").bitwiseAND(0xFFFFFFFF) for t in (text, F.concat(F.lit("low:"), text)))
            return F.when(text.isNotNull(), F.shiftleft(high, BITS - 32).bitwiseOR(F.shiftright(low, 64 - BITS)))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")

    def h32s(self, item: str | Column) -> tuple[Column, Column]:
        """Two 32-bit hashes (for double hashing)."""
        if self.kind != "portable":
            h, g = self.h60(item), self.h60(item, "2:")
            return F.shiftright(h, 28), F.shiftright(g, 28)
        digest = F.md5(as_column(item).cast("string").cast("binary"))
        part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
        return part(1), part(9)

    def parts(self, item: str | Column, n: int) -> list[Column]:
        """n independent hashes of 30 bits at least: four from each md5, two from each 64-bit hash."""
        text = as_column(item).cast("string")
        out = []
        for i in range(n):
            if self.kind == "portable":
                digest = F.md5(F.concat(F.lit(f"{i // 4}:"), text).cast("binary"))
                out.append(F.conv(F.substring(digest, 1 + 8 * (i % 4), 8), 16, 10).cast("bigint"))
            else:
                h = self.h60(item, f"{i // 2}:")
                out.append(F.shiftright(h, 30) if i % 2 else h.bitwiseAND((1 << 30) - 1))
        return out

    def unit(self, item: str | Column, salt: str = "") -> Column:
        """A double in (0, 1) that depends on the item and the salt alone."""
        return (self.h60(item, salt).cast("double") + F.lit(0.5)) / F.lit(SPAN)


def present(df, item: str | Column):
    """df without the rows whose item is null. Asked of the item, not of its hash, so that the hash is computed once."""
    return df.where(as_column(item).isNotNull())


PORTABLE = Hasher("portable")
FAST = Hasher("fast")
MURMUR3 = Hasher("murmur3")


def bit_length(col: Column) -> Column:
    """Number of bits of a non-negative long, 0 for 0: the logarithm, which may be off by one near powers of two, put right by shifts."""
    n = F.floor(F.log2(F.greatest(col, F.lit(1)).cast("double"))).cast("int")
    shifted = lambda by: F.call_function("shiftright", col, by)
    return F.when(col <= 0, 0).when(shifted(n) == 0, n).when(shifted(n + 1) > 0, n + 2).otherwise(n + 1)


def power2(col: Column) -> Column:
    return F.pow(F.lit(2.0), col.cast("double"))
