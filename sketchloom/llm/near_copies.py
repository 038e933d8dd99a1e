"""Near copies by a similarity threshold: 0.8 or more on the sets of five-word shingles, one document of each group kept.

Ball hashing (``simhash``) asks for the closest pairs. Fingerprints of 64 bits are too coarse near the threshold, so an exact join on the sets of
64-bit shingle hashes completes it:

1. A class is a distinct set, with its smallest document. Sets 0.8 alike share one of their first fifth of shingles in any common order, here
   rarest first as far as a sample tells, and by further looks at the shingles that turn out to be in very many first fifths; a shingle in the first fifth of
   several classes is a bucket.
2. Each class is asked with the head (smallest id) of its buckets and with what ball hashing met. Sizes and parities of the sets rule out
   most questions; the rest are verified on the whole sets, and verified links give components.
3. In buckets whose other members components do not hold together yet, all outside the bucket's largest component (strays) are compared with all members of
   other components, in blocks of bounded size. Sizes, places and parities rule out most. Of the rest a stray asks the NEAREST ones by parities in each block;
   these are verified, the components united, and strays that had more left ask again, GROWTH times as many, until none has any left. Most then are
   in the stray's own component, so a group's links are not spelled out.

So every link of the whole table is found, or both ends are in one component already. What is shuffled are classes, their first fifths, questions and the sets of
questioned classes; texts only where more are asked for than their keys can be sent to. The rows made are in proportion to the rows read, but for members of a
bucket dealt to several blocks and near misses (pairs that parities do not rule out, but whole sets do). Only the comparisons of parities in step 3 grow with the
product of a bucket's strays and its members: no exact method knows that a stray has no partner without looking.

A null text counts as empty; all texts without words are copies of each other. Repeated rows are copies. A null doc_id comes after all others
when the document that stays is chosen. Class ids are 64-bit hashes of sets; those that fall together by chance (n^2 / 2^65 expected) are told apart
by a second hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, release, slices_of, text_key
from .simhash import SEED, components, links, majority

ALIKE = (4, 5)
SAMPLE, FREQUENT, HEAVY, LOOKS = 8_000, 200_000, 10_000, 3
PARITY = 2048
BLOCK, PART = 500, 5_000
NEAREST, GROWTH = 2, 8
PAIRS = 20_000
KEYS_SENT = 1_000_000
SLICE = 1_000_000


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``width`` words, sorted; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]  # noqa: B905
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, parts, repeat(SEED)), dtype=np.uint64, count=max(1, len(words) - width + 1)).view(np.int64))


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)])))


def frequent_shingles(docs: DataFrame, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that recur in a sample of texts, and about how many texts hold them. They only order the shingles of a text, so that
    buckets are small: any order gives the same pairs."""

    def run(batches):
        for b in slices_of(batches, SLICE):
            sets = [shingle_set(t, width) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([lists(sets).flatten()], ["token"])

    every = max(1, docs.count() // SAMPLE)
    texts = docs.select(F.xxhash64("text").alias("h"), "text").where(F.pmod("h", F.lit(every)) == 0).dropDuplicates(["h"])
    counts = texts.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow().sort_by("token")
    return rows["token"].to_numpy(), rows["n"].to_numpy() * every


def with_heavy(order: tuple[np.ndarray, np.ndarray], shared: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The order with the shingles that over HEAVY classes have in their first fifths (at most FREQUENT of them, the heaviest); None if it knows them
    already. A sample of fixed size can't know those that are rare among all texts and yet many."""
    rows = shared.where(F.col("m") > HEAVY).orderBy(F.desc("m"), "token").limit(FREQUENT).select("token", "m").toArrow()
    if np.isin(rows["token"].to_numpy(), order[0]).all():
        return None
    tokens = np.concatenate([order[0], rows["token"].to_numpy()])
    counts = np.concatenate([order[1], rows["m"].to_numpy()])
    at = np.lexsort((-counts, tokens))
    keep = at[np.concatenate([[True], np.diff(tokens[at]) != 0])]
    return tokens[keep], counts[keep]


def prefix_length(n: int) -> int:
    """Of n shingles in a common order, so many first ones that two sets 0.8 alike share one among them."""
    return n - -(-ALIKE[0] * n // ALIKE[1]) + 1 if n else 0


def described(docs: DataFrame, width: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """k_id, k_text, id and id2 (hashes of the shingle set), n (its size), fp (its fingerprint), bits (parity of its hashes modulo PARITY, as longs)
    and its prefix, rarest first."""
    tokens, counts = order

    def one(text):
        found = ordered = shingle_set(text, width)
        if len(tokens) and len(found):
            at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
            ordered = found[np.argsort(np.where(tokens[at] == found, counts[at], 0), kind="stable")]
        parity = np.bincount(found & (PARITY - 1), minlength=PARITY) & 1
        raw = found.tobytes()
        ids = xxhash.xxh3_64_intdigest(raw, SEED), xxhash.xxh3_64_intdigest(raw, SEED + 1), majority(found)
        return *ids, len(found), np.packbits(parity.astype(np.uint8)).view(np.int64), ordered[: prefix_length(len(found))]

    def run(batches):
        for b in slices_of(batches, SLICE):
            if b.num_rows:
                *ids, sizes, bits, first = zip(*map(one, b.column("text").to_pylist()), strict=True)
                longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in ids]
                cols = [b.column("k_id"), b.column("k_text"), *longs, pa.array(sizes, pa.int32()), lists(bits), lists(first)]
                yield pa.RecordBatch.from_arrays(cols, ["k_id", "k_text", "id", "id2", "fp", "n", "bits", "prefix"])

    kinds = "k_id long, k_text long, id long, id2 long, fp long, n int, bits array<long>, prefix array<long>"
    return docs.select(*text_key(), "text").mapInArrow(run, kinds)


def classes_of(docs: DataFrame, width: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """id, id2, first (struct of no_id, k_id, k_text: the smallest document), fp, n, bits, prefix: one row per distinct set. Copies fall together before the shuffle."""
    first = F.struct((F.col("k_id") == -(2**63)).alias("no_id"), "k_id", "k_text").alias("first")
    least = described(docs, width, order).groupBy("id", "id2").agg(F.min(F.struct(first, "fp", "n", "bits", "prefix")).alias("c"))
    classes = cut(least.select("id", "id2", "c.*"), "near-classes")
    twins = [r["id"] for r in classes.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").collect()]
    if twins:
        path, own = classes.cut_path, F.when(F.col("id").isin(twins), F.xxhash64("id", "id2")).otherwise(F.col("id"))
        classes = classes.withColumn("id", own)
        classes.cut_path = path
    return classes


def shared_shingles(classes: DataFrame) -> DataFrame:
    """(token, m, head): the prefix shingles that m > 1 classes hold, and the smallest id among these. Counts are combined before they are shuffled."""
    held = classes.select("id", F.explode("prefix").alias("token"))
    return cut(held.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("head")).where("m > 1"), "near-shared")


def met_shingles(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(token, head, id, n, pos): the shared prefix shingles, the head, and the class with the place it has the shingle at. The join can split a very frequent
    shingle."""
    held = classes.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    place = (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("place")  # one long for two, since there are many of these rows
    met = held.select("token", "id", place).join(shared.select("token", "head"), "token")
    met = cut(met.select("token", "head", "id", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(2**32 - 1).cast("int").alias("pos")), "near-met")
    release(shared)
    return met


def sizes_fit(n1: Column, n2: Column) -> Column:
    return ALIKE[1] * F.least(n1, n2) >= ALIKE[0] * F.greatest(n1, n2)


def parities_fit(n1: Column, bits1: Column, n2: Column, bits2: Column) -> Column:
    """Each shingle in one set only changes one of the parities."""
    differ = sum((F.bit_count(bits1[i].bitwiseXOR(bits2[i])) for i in range(PARITY // 64)), F.lit(0))
    return sum(ALIKE) * differ <= (ALIKE[1] - ALIKE[0]) * (n1 + n2)


def may_be_alike(classes: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of ``asked`` (ids a and b) that sizes and parities do not rule out."""
    about = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    na, nb = F.col("na"), F.col("nb")
    fits = sizes_fit(na, nb) & parities_fit(na, F.col("bitsa"), nb, F.col("bitsb"))
    return asked.join(about("a"), "a").join(about("b"), "b").where(fits).select("a", "b")


def first_questions(classes: DataFrame, met: DataFrame) -> DataFrame:
    """(a, b): each class with the heads of its buckets, and with what ball hashing links its fingerprint to; only those that may be alike."""
    stars = met.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    heads = cut(classes.groupBy("fp").agg(F.min("id").alias("head")), "near-heads")
    same = classes.select("id", "fp").join(heads, "fp").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    end = lambda k: heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_id"))
    balls = links(heads.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    asked = cut(may_be_alike(classes, stars.unionByName(same).unionByName(balls).distinct()), "near-asked")
    release(heads)
    return asked


def alike(docs: DataFrame, classes: DataFrame, asked: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``asked`` (ids a and b) whose shingle sets are 0.8 alike, by all shingles. The keys of the texts go to where these are, if they are KEYS_SENT
    at most (tens of MB); beyond that both are shuffled."""

    def run(batches):
        seen: set[int] = set()  # a repeated row gives its set once in a task
        for b in slices_of(batches, SLICE):
            fresh = [not (i in seen or seen.add(i)) for i in b.column("id").to_pylist()]
            b = b.filter(pa.array(fresh, pa.bool_()))
            cols = [b.column(c) for c in ("id", "in_a", "in_b")]
            yield pa.RecordBatch.from_arrays([*cols, lists([shingle_set(t, width) for t in b.column("text").to_pylist()])], ["id", "in_a", "in_b", "tokens"])

    ends = [asked.select(F.col(k).alias("id"), F.lit(k == "a").alias("in_a"), F.lit(k == "b").alias("in_b")) for k in ("a", "b")]
    ids = ends[0].unionByName(ends[1]).groupBy("id").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))
    keys = cut(classes.select("id", "first.k_id", "first.k_text").join(ids, "id"), "near-keys")
    sent = F.broadcast(keys) if keys.count() <= KEYS_SENT else keys
    texts = docs.select(*text_key(), "text").join(sent, ["k_id", "k_text"]).select("id", "in_a", "in_b", "text")
    made = texts.mapInArrow(run, "id long, in_a boolean, in_b boolean, tokens array<long>")
    sets = cut(made, "near-sets")
    side = lambda k: sets.where(f"in_{k}").select(F.col("id").alias(k), F.col("tokens").alias(f"t{k}"))
    enough = sum(ALIKE) * F.size(F.array_intersect("ta", "tb")) >= ALIKE[0] * (F.size("ta") + F.size("tb"))
    found = cut(asked.join(side("a"), "a").join(side("b"), "b").where(enough).select("a", "b").distinct(), "near-alike")
    release(keys, sets)
    return found


def open_rows(classes: DataFrame, met: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, id, n, pos, bits, stray, blocks, parts): the buckets that hold several components, without their heads, which have their answers. Members outside
    a bucket's largest component are strays. Each pair that is still to be compared has a stray."""
    named = met.where("id <> head").join(labels.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "pos", F.coalesce("label", "id").alias("label"))
    named = cut(named, "near-named")
    held = named.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    open_ = held.groupBy("token").agg(F.sum("c").alias("m"), F.max(F.struct("c", "label")).alias("most")).where("m > most.c")
    count = lambda x, size: F.ceil(x / size).cast("int")
    open_ = open_.select("token", F.col("most.label").alias("main"), count(F.col("m") - F.col("most.c"), BLOCK).alias("blocks"), count(F.col("m"), PART).alias("parts"))
    rows = named.join(open_, "token").join(classes.select("id", "bits"), "id")
    rows = cut(rows.select("token", "id", "n", "pos", "bits", (F.col("label") != F.col("main")).alias("stray"), "blocks", "parts"), "near-rows")
    release(named)
    return rows


def groups_of(batches, keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each key in one batch, from batches that are sorted by the keys."""
    held = None
    for b in batches:
        b = pa.concat_batches([held, b]) if held is not None else b
        if b.num_rows:
            at = np.stack([b.column(k).to_numpy() for k in keys])
            starts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()]
            for lo, hi in zip(starts, starts[1:]):  # noqa: B905
                yield b.slice(lo, hi - lo)
            held = b.slice(starts[-1])
    if held is not None:
        yield held


def nearest_in(group: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id, other, more): for each row that asks the k others of another component, by parities the nearest, that sizes, places and parities do not rule out; and whether
    there are more than k. Places: what is left after a shared shingle is enough, which is true of every pair 0.8 alike at the first shingle they share."""
    asks = group.column("asks").to_numpy(zero_copy_only=False)
    ids, n, pos, label = (group.column(c).to_numpy().astype(np.int64) for c in ("id", "n", "pos", "label"))
    bits = group.column("bits").flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    for lo in range(0, len(x), step := max(1, PAIRS // max(1, len(y)))):
        s = x[lo : lo + step, None]
        sizes = ALIKE[1] * np.minimum(n[s], n[y]) >= ALIKE[0] * np.maximum(n[s], n[y])
        places = sum(ALIKE) * np.minimum(n[s] - pos[s], n[y] - pos[y]) >= ALIKE[0] * (n[s] + n[y])
        i, j = np.nonzero((label[s] != label[y]) & sizes & places)
        i, j = s[i, 0], y[j]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        fits = sum(ALIKE) * differ <= (ALIKE[1] - ALIKE[0]) * (n[i] + n[j])
        i, j, differ = i[fits], j[fits], differ[fits]
        order = np.lexsort((ids[j], differ, i))
        i, j = i[order], j[order]
        first, end = np.searchsorted(i, i, "left"), np.searchsorted(i, i, "right")
        near = np.arange(len(i)) - first < k
        yield ids[i[near]], ids[j[near]], (end - first > k)[near]


def nearest_others(rows: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(token, id, other, more): nearest_in() for the strays of each bucket. Strays are dealt to blocks, each in all parts, and all members to parts, each in all
    blocks, so a stray and a member meet once in a bucket, and what a task holds at once is bounded."""

    def run(batches):
        for g in groups_of(batches, ("token", "block", "part")):
            for ids, others, more in nearest_in(g, k):
                if len(ids):
                    token = np.full(len(ids), g.column("token")[0].as_py(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(ids), pa.array(others), pa.array(more)], ["token", "id", "other", "more"])
        give_back()

    named = rows.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    dealt = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    about = ["id", "n", "pos", "bits", "label"]
    strays = named.where("stray").select("token", dealt("blocks").alias("block"), each("parts").alias("part"), F.lit(True).alias("asks"), *about)
    others = named.select("token", each("blocks").alias("block"), dealt("parts").alias("part"), F.lit(False).alias("asks"), *about)
    keys = ["token", "block", "part"]
    met = strays.unionByName(others).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(run, "token long, id long, other long, more boolean")


def with_strays(docs: DataFrame, classes: DataFrame, rows: DataFrame, labels: DataFrame, width: int = 5) -> DataFrame:
    """(node, label) of the components that ``labels`` and all links in the buckets ``rows`` give together. In a round strays ask their nearest others in other
    components; those that had more stay strays and ask GROWTH times as many in the next. Components only grow, so when no stray has more, both ends of each
    pair that may be alike have been asked or are in one component."""
    k, strays, last, earlier = NEAREST, rows, [], []
    while True:
        near = cut(nearest_others(strays, labels, k), "near-nearest")
        asked = near.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")).distinct()
        for done in earlier:
            asked = asked.join(done, ["a", "b"], "left_anti")
        asked = cut(asked, "near-asked2")
        earlier.append(asked)
        if not asked.isEmpty():
            found = alike(docs, classes, asked, width)
            before, labels = labels, united(labels, found)
            release(before, found)
        more = cut(near.where("more").select("token", "id").distinct(), "near-more")
        release(near, *last)
        if more.isEmpty():
            release(rows, more, *earlier)
            return labels
        left = rows.drop("stray").join(more.select("token").distinct(), "token", "left_semi")
        strays = left.join(more.withColumn("stray", F.lit(True)), ["token", "id"], "left").withColumn("stray", F.coalesce("stray", F.lit(False)))
        k, last = GROWTH * k, [more]


def united(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label) of the components that ``labels`` and the links ``found`` between their nodes give together."""
    label = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    ends = found.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    moved = components(ends.where("la <> lb").select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")))
    kept = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
    every = kept.select("node", F.coalesce("next", "label").alias("label")).unionByName(moved.join(labels.select("node"), "node", "left_anti"))
    every = cut(every, "near-united")
    release(moved)
    return every


def copy_labels(docs: DataFrame, classes: DataFrame, shared: DataFrame, width: int = 5) -> DataFrame:
    """(node, label) of the classes that have near copies: the smallest id that each can reach."""
    met = met_shingles(classes, shared)
    asked = first_questions(classes, met)
    release()
    found = alike(docs, classes, asked, width)
    release(asked)
    labels = components(found)
    release(found)
    rows = open_rows(classes, met, labels)
    release(met)
    return with_strays(docs, classes, rows, labels, width)


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """docs with one row of each group of near copies (0.8 or more alike on shingles of ``width`` words, or linked by rows that are) kept: that of the smallest
    doc_id (null last; ties by text hash). All columns stay."""
    cols = docs.columns
    order = frequent_shingles(docs, width)
    classes = classes_of(docs, width, order)
    shared = shared_shingles(classes)
    release()
    for _ in range(LOOKS):  # other heavy ones may move up; in a group of near copies all are heavy, so this has an end
        if (better := with_heavy(order, shared)) is None:
            break
        release(classes, shared)
        order = better
        classes = classes_of(docs, width, order)
        shared = shared_shingles(classes)
        release()
    labels = copy_labels(docs, classes, shared, width)
    linked = classes.join(labels.withColumnRenamed("node", "id"), "id", "left").select("first", F.coalesce("label", "id").alias("label"))
    kept = cut(linked.groupBy("label").agg(F.min("first").alias("first")).select("first.k_id", "first.k_text"), "near-kept")
    release(classes, labels)
    rows = docs.select(F.struct(*cols).alias("row"), *text_key()).join(kept, ["k_id", "k_text"])
    copy = F.row_number().over(Window.partitionBy("k_id", "k_text").orderBy("k_text"))
    return rows.withColumn("copy", copy).where("copy = 1").select("row.*")
