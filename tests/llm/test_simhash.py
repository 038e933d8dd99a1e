import random
import re

import xxhash
from pyspark.sql import functions as F

from sketchloom.llm import simhash as s

from .conftest import ODD


def brute_fingerprint(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(marks, radius=2):
    label = {i: i for i in marks}
    moved = True
    while moved:
        moved = False
        for i in marks:
            for j in marks:
                if bin(marks[i] ^ marks[j]).count("1") <= radius and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def texts():
    rnd = random.Random(2)
    base = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(rnd.choice([1, 2, 3, 9, 80, 300]))) for _ in range(25)]
    out = base + [b.upper() for b in base[:5]]
    for b in base:
        w = b.split()
        w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return list(enumerate(out + ["", " \x0b\x0c", None, "İ ıK ß"]))


def test_against_brute_force(docs):
    rows = texts()
    got = {r["doc_id"]: r for r in s.simhash_digest(docs(rows)).collect()}
    marks = {i: brute_fingerprint(t) for i, t in rows}
    label = brute_components(marks)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in marks.items()}
    assert {i: r["component_id"] for i, r in got.items()} == label


def test_chains_of_variants(spark):
    """Fingerprints at two bits from each other in a long chain are one component; three bits away is another."""
    rnd, chain = random.Random(3), [rnd_start := 0x0123456789ABCDEF]
    for i in range(40):
        chain.append(chain[-1] ^ (1 << (i % 32)) ^ (1 << (63 - i % 30)))
    lone = [rnd.getrandbits(64) for _ in range(50)]
    signed = [(x - (1 << 64) if x >= 1 << 63 else x,) for x in {*chain, *lone}]
    frame = spark.createDataFrame(signed, "fp long")
    label = {r["fp"]: r["label"] for r in s.class_labels(frame).collect()}
    marks = {x[0]: x[0] & (2**64 - 1) for x in signed}
    assert label == brute_components(marks)
    assert rnd_start in marks.values()


def test_links_are_verified_stars(spark):
    frame = spark.createDataFrame([(0,), (1,), (2,), (4,), (7,)], "fp long")
    for r in s.links(frame).collect():
        assert bin(r["a"] ^ r["b"]).count("1") <= 2 and r["a"] > r["b"]
    assert len(s.ball_masks(2)) == 65 and len(s.ball_masks(4)) == 1 + 64 + 64 * 63 // 2


def test_spark_hash_is_the_same(spark):
    for t in ("", "a b c", "ünï 😀 x", "x" * 100):
        assert spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] % 2**64 == xxhash.xxh64_intdigest(t.encode(), 42)


def test_odd_rows(docs):
    rows = s.near_duplicates(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[1] == by[4] == 0 and by[3] == by[2] == 2
    assert s.near_duplicates(docs(ODD).where("false")).count() == 0


def test_majority_in_blocks(monkeypatch):
    import numpy as np

    h = np.random.default_rng(1).integers(0, 2**64, 1001, dtype=np.uint64)
    whole = s.majority(h)
    monkeypatch.setattr(s, "UNPACKED", 100)
    assert s.majority(h) == whole and s.majority(h[:0]) == 0


def test_a_very_long_text(docs):
    rows = [(1, "some words of a long text " * 1_500_000), (2, "short")]
    assert {r["doc_id"]: r["component_id"] for r in s.near_duplicates(docs(rows)).collect()} == {1: 1, 2: 2}
