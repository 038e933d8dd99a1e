"""Exact repeated-substring removal by column-wise construction over many documents.

Every byte covered by a string of ``length`` bytes that starts at two places (of any documents) is removed. Matches never cross documents.

1. Anchors. Each window of ``length`` bytes picks its smallest k-gram by a mixed rolling hash (leftmost of equals), a function of
   the window alone, so equal windows pick equal anchors at equal offsets. Windows that share an anchor are neighbours:
   they form a segment, about one per (length - k) / 2 bytes, and every window lies in exactly one.
2. Segments meet by anchor. An anchor seen once clears all its windows. Segments with equal bytes form a class; a class of two or
   more is repeated as a whole. One representative of each class goes on where an anchor has different classes.
3. Their bytes, aligned at the anchor, are the collection for the column-wise construction: from the last column to the first, one symbol per
   segment is inserted in front of all suffixes, the order (whose symbols are that column of the collection's
   Burrows-Wheeler transform) is updated by one stable sort and the common-prefix array by range minima. Where a
   common prefix reaches ``length``, the window is repeated. Columns are read and written strictly in sequence; they are held in
   task memory of bounded size rather than in files, because executors share no local folder that would survive them.
4. An anchor with more than HOT classes would not fit one task: there each window stands for itself under its own hash, and windows
   that meet are repeated. This is exact too and has no bound on the group.

The same search runs over words instead of bytes: a passage is a run of more than PASSAGE words that also stands elsewhere. There a symbol is the
64-bit hash of a word.

What is gathered in one row is the segments or ranges of one document, fewer than it has bytes. A null text counts as empty. Repeated rows repeat each
other's windows. Rows are keyed by id and text hash, so null or repeated ids are safe; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, slices_by_bytes, slices_of, text_key

LENGTH = 400
GRAM = 32
PASSAGE, WORD_GRAM = 50, 8
PIECE = 1_500_000
SLICE = 1_500_000
PLACE_BITS = 24
HOT = 20_000
BATCH = 6_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def word_hashes(raw: bytes) -> np.ndarray:
    words = raw.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(7)), dtype=np.uint64, count=len(words))


@dataclass(frozen=True)
class Unit:
    """What a window is counted in. symbols: of a text's bytes; gram: symbols of an anchor (a power of two)."""

    symbols: Callable[[bytes], np.ndarray]
    gram: int
    kind: type


BYTES = Unit(lambda raw: np.frombuffer(raw, dtype=np.uint8), GRAM, np.uint8)
WORDS = Unit(word_hashes, WORD_GRAM, np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed hash of the gram (a power of two) that begins at each symbol."""
    h, power, width = _BYTE[data] if data.dtype == np.uint8 else _mix(data), _BASE, 1
    while width < gram:
        h = h[:-width] * power + h[width:]
        power, width = power * power, width * 2
    return _mix(h)


def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        v, step = np.minimum(v[:-step], v[step:]), step * 2
    rest = width - step
    return np.minimum(v[: len(v) - rest], v[rest:]) if rest else v


def segments(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, first window, last window, place of the anchor) of every segment of documents that lie one after another in
    data, document i from starts[i] to starts[i + 1]."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none
    with np.errstate(over="ignore"):
        h = gram_hashes(data, gram)
    keep = np.uint64(2**64 - 2**PLACE_BITS)
    low = window_minima((h & keep) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    last = starts[1:] - length
    ok = last >= starts[:-1]
    lengths = (last - starts[:-1] + 1)[ok]
    if not len(lengths):
        return none, none, none, none
    ids = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts[:-1][ok], lengths)
    place = (low[at] & np.uint64(2**PLACE_BITS - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (ids[1:] != ids[:-1])]))
    final = np.append(first[1:], len(at)) - 1
    return h[place[first]].view(np.int64), at[first], at[final], place[first]


SEGMENT = "a long, d long, k_id long, k_text long, s0 long, s1 long, off int"


def all_segments(docs: DataFrame, length: int, unit: Unit = BYTES) -> DataFrame:
    """One row per segment: anchor hash, hash of its symbols, key of the document, first and last window, the anchor's offset."""

    def run(batches):
        for b in slices_of(batches, SLICE):
            texts = [unit.symbols((t or "").encode("utf-8")) for t in b.column("text").to_pylist()]
            ids, keys = b.column("k_id").to_numpy(zero_copy_only=False), b.column("k_text").to_numpy(zero_copy_only=False)
            pieces = []  # (row, first symbol): a long text goes in pieces that share length - 1 symbols, so no window is lost or doubled
            for i, t in enumerate(texts):
                pieces += [(i, o) for o in range(0, max(0, len(t) - length + 1), PIECE)]
            sizes = [min(PIECE + length - 1, len(texts[i]) - o) for i, o in pieces]
            for lo, hi in slices_by_bytes(sizes, PIECE):
                part = pieces[lo:hi]
                data = np.concatenate([texts[i][o : o + n] for (i, o), n in zip(part, sizes[lo:hi], strict=True)])
                starts = np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int64)
                a, s0, s1, place = segments(data, starts, length, unit.gram)
                if not len(a):
                    continue
                view, wide = memoryview(data).cast("B"), data.itemsize
                spans = zip((s0 * wide).tolist(), ((s1 + length) * wide).tolist(), strict=True)
                d = np.fromiter((xxhash.xxh3_64_intdigest(view[x:y]) for x, y in spans), np.uint64, len(a))
                piece = np.searchsorted(starts, s0, side="right") - 1
                row = np.array([i for i, _ in part])[piece]
                shift = np.array([o for _, o in part], dtype=np.int64)[piece] - starts[piece]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (a, d.view(np.int64), ids[row], keys[row], s0 + shift, s1 + shift, (place - s0).astype(np.int32))],
                    ["a", "d", "k_id", "k_text", "s0", "s1", "off"],
                )

    return docs.select(*text_key(), "text").mapInArrow(run, SEGMENT)


def repeated_windows(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH, kind: type = np.uint8) -> list[np.ndarray]:
    """For each (group, anchor offset, windows, bytes of the symbols): which of its windows also start in another row of its group.

    Column by column from the right: ``order`` holds the rows by their suffix from this column on, ``lcp`` the common prefix of
    neighbours in it. Rows of a group stay together."""
    n = len(rows)
    left = max(r[1] for r in rows)
    lo = np.array([left - r[1] for r in rows])
    data = [np.frombuffer(r[3], dtype=kind) for r in rows]
    if kind is np.uint8:
        data = [x.astype(np.uint16) + 1 for x in data]
    else:  # other symbols by their rank in this batch
        numbers = np.unique(np.concatenate(data), return_inverse=True)[1].astype(np.uint32) + 1
        data = np.split(numbers.astype(np.uint16) if numbers.max() < 2**16 else numbers, np.cumsum([len(x) for x in data])[:-1])
    size = np.array([len(x) for x in data])
    width = int((lo + size).max())
    table = np.zeros((width, n), dtype=data[0].dtype)
    for i, x in enumerate(data):
        table[lo[i] : lo[i] + size[i], i] = x
    names = {g: i for i, g in enumerate(dict.fromkeys(r[0] for r in rows))}
    group = np.array([names[r[0]] for r in rows], dtype=np.int64)
    windows = np.array([r[2] for r in rows])
    found = np.zeros((int(windows.max()), n), dtype=bool)
    order = np.argsort(group, kind="stable")
    lcp = np.zeros(n + 1, dtype=np.int32)
    for col in range(width - 1, -1, -1):
        sym = table[col, order]
        by = np.argsort(sym, kind="stable")
        g = group[order[by]]
        if n > 1 and (g[1:] < g[:-1]).any():
            by = by[np.argsort(g.astype(np.uint16) if len(names) < 65536 else g, kind="stable")]
        s, moved = sym[by], order[by]
        g = group[moved]
        fresh = np.zeros(n + 1, dtype=np.int32)
        near = np.flatnonzero((s[1:] == s[:-1]) & (g[1:] == g[:-1]) & (s[1:] > 0)) + 1
        if len(near):
            spans = np.empty(2 * len(near), dtype=np.int64)
            spans[::2], spans[1::2] = by[near - 1] + 1, by[near] + 1
            fresh[near] = np.minimum.reduceat(lcp, spans)[::2] + 1
        order, lcp = moved, fresh
        at = col - lo[order]
        hit = np.flatnonzero((np.maximum(lcp[:-1], lcp[1:]) >= length) & (at >= 0) & (at < windows[order]))
        found[at[hit], order[hit]] = True
    return [found[: windows[i], i] for i in range(n)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last index of every run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


OPEN = pa.schema([(k, pa.int64()) for k in ("a", "w", "k_id", "k_text", "s0", "n_win")] + [("off", pa.int32()), ("alone", pa.bool_()), ("bytes", pa.binary())])


def open_segments(docs: DataFrame, reps: DataFrame, length: int, unit: Unit) -> DataFrame:
    """Symbols of the representatives: (a, w, k_id, k_text, s0, n_win, off, alone, bytes); for a hot anchor a row per window under its
    hash w, without bytes."""
    listed = reps.groupBy("k_id", "k_text").agg(F.collect_list(F.struct("a", "s0", "s1", "off", "alone", "hot")).alias("segs"))
    text = docs.select(*text_key(), "text")
    joined = text.join(listed, ["k_id", "k_text"]).select("k_id", "k_text", "text", "segs")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), OPEN, strict=True)], schema=OPEN)

    def run(batches):
        for b in slices_of(batches, SLICE):
            out: list[tuple] = []
            for k_id, k_text, text, segs in zip(*(b.column(c).to_pylist() for c in ("k_id", "k_text", "text", "segs")), strict=True):
                data = unit.symbols((text or "").encode("utf-8"))
                raw, wide = data.tobytes(), data.itemsize
                for s in segs:
                    a, s0, s1 = s["a"], s["s0"], s["s1"]
                    if not s["hot"]:
                        out.append((a, 0, k_id, k_text, s0, s1 - s0 + 1, s["off"], s["alone"], raw[s0 * wide : (s1 + length) * wide]))
                        continue
                    for x in range(s0, s1 + 1):
                        w = xxhash.xxh3_64_intdigest(raw[x * wide : (x + length) * wide]) >> 1
                        out.append((a, w or 1, k_id, k_text, x, 1, 0, s["alone"], b""))
                    if len(out) > 20_000:
                        yield batch_of(out)
                        out = []
            if out:
                yield batch_of(out)

    return joined.mapInArrow(run, "a long, w long, k_id long, k_text long, s0 long, n_win long, off int, alone boolean, bytes binary")


def matched(opened: DataFrame, length: int, unit: Unit = BYTES) -> DataFrame:
    """(k_id, k_text, a0, a1): byte ranges found repeated among the opened segments."""
    out_type = pa.schema([("k_id", pa.int64()), ("k_text", pa.int64()), ("a0", pa.int64()), ("a1", pa.int64())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out_type)

    def resolve(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        hits = repeated_windows([(r[0], r[6], r[5], r[8]) for r in rows], length, unit.kind)
        return [(r[2], r[3], r[4] + x, r[4] + y + length) for r, flags in zip(rows, hits, strict=True) if r[7] and flags.any() for x, y in runs(flags)]

    def run(batches):
        held: list[tuple] = []  # whole groups, and the group that is being read
        begin, key, first, size = 0, None, None, 0
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if r[1]:  # a window on its own: the first of its kind waits for a second
                    if key == r[:2]:
                        if first is not None:
                            out.append((first[2], first[3], first[4], first[4] + length))
                            first = None
                        out.append((r[2], r[3], r[4], r[4] + length))
                    else:
                        key, first = r[:2], r
                    continue
                if key != r[:2]:
                    if len(held) >= BATCH:
                        out += resolve(held)
                        held = []
                    begin, key = len(held), r[:2]
                held.append(r)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(resolve(held))

    return opened.repartition("a", "w").sortWithinPartitions("a", "w").mapInArrow(run, "k_id long, k_text long, a0 long, a1 long")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, unit: Unit = BYTES) -> DataFrame:
    """(k_id, k_text, a0, a1): ranges [a0, a1) of symbols made of repeated windows, per document key; they may overlap."""
    found = cut(all_segments(docs, length, unit), "segments")
    # written, so that the joins below deal both sides anew and a very frequent anchor's rows, which come from all tasks, can be split among tasks
    twice = cut(found.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("a"), "anchors")
    release()
    least = F.min(F.struct("k_id", "k_text", "s0", "s1", "off")).alias("rep")
    # by one struct: grouped by its two columns, the rows would stay where the join on ``a`` put them, a frequent anchor's in one task and not yet combined
    grouped = found.join(twice, "a", "left_semi").groupBy(F.struct("a", "d").alias("ad")).agg(F.count(F.lit(1)).alias("n"), least)
    classes = cut(grouped.select("ad.*", "n", "rep"), "classes")
    release(twice)
    many = cut(classes.groupBy("a").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "many")
    whole = found.join(classes.where("n > 1").select("a", "d"), ["a", "d"], "left_semi")
    whole = cut(whole.select("k_id", "k_text", F.col("s0").alias("a0"), (F.col("s1") + length).alias("a1")), "whole")
    release(found)
    reps = classes.join(many, "a").select("a", "rep.*", (F.col("n") == 1).alias("alone"), (F.col("m") > HOT).alias("hot"))
    parts = cut(matched(open_segments(docs, reps, length, unit), length, unit), "parts")
    release(classes, many)
    return whole.unionByName(parts)


def merged(ranges: list[dict]) -> list[dict]:
    """Maximal runs of ranges that meet or overlap, ascending."""
    out: list[dict] = []
    for r in sorted(ranges, key=lambda r: r["a0"]):
        if out and r["a0"] <= out[-1]["a1"]:
            out[-1]["a1"] = max(out[-1]["a1"], r["a1"])
        else:
            out.append({"a0": r["a0"], "a1": r["a1"]})
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<a0, a1>> (maximal removed byte runs, ascending), kept binary, n_passage_words: one row per document.
    n_passage_words: words in runs of more than ``passage`` words that also stand elsewhere (null without ``passage``)."""
    ranges = repeated_ranges(docs, length).withColumn("words", F.lit(False))
    if passage is not None:
        ranges = ranges.unionByName(repeated_ranges(docs, passage + 1, WORDS).withColumn("words", F.lit(True)))
    ranges = ranges.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("words", "a0", "a1")).alias("ranges"))
    joined = docs.select("doc_id", *text_key(), "text").join(ranges, ["k_id", "k_text"], "left").select("doc_id", "text", "ranges")
    span = pa.list_(pa.struct([("a0", pa.int64()), ("a1", pa.int64())]))

    def run(batches):
        for b in slices_of(batches, SLICE):
            n, spans, kept, words = [], [], [], []
            for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                raw, parts, at = (text or "").encode("utf-8"), [], 0
                gone = merged([r for r in ranges or [] if not r["words"]])
                for r in gone:
                    parts.append(raw[at : r["a0"]])
                    at = r["a1"]
                n.append(len(raw))
                spans.append(gone)
                kept.append(b"".join([*parts, raw[at:]]))
                words.append(None if passage is None else sum(r["a1"] - r["a0"] for r in merged([r for r in ranges or [] if r["words"]])))
            cols = [b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(words, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept", "n_passage_words"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<a0:long,a1:long>>, kept binary, n_passage_words long")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The columns of query op9, and n_passage_words: strings of LENGTH bytes miss passages of over PASSAGE words that are shorter than that."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["a1"] - s["a0"])
    return without_repeats(docs, passage=PASSAGE).select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "n_passage_words",
    )
