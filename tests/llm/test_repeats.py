import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sketchloom.llm import repeats as r

from .conftest import ODD


def brute(rows, length):
    """doc -> (bytes, removed, spans, digest), every window looked up in a counter."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(x[j : j + length] for _, x in raw for j in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            if seen[x[j : j + length]] > 1:
                gone[j : j + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(x), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [word(n) for n in (60, 63, 64, 65, 150, 400)]
    rows = []
    for i in range(60):
        rows.append((i, "".join(rnd.choice([word(rnd.randint(0, 90)), rnd.choice(passages), rnd.choice(passages)[5:]]) for _ in range(rnd.randint(0, 6)))))
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, "ab" * 300), (201, "z" * 500), (202, "z" * 64), (203, "z" * 63)]
    return rows + ODD


def brute_words(rows, length):
    """doc -> words covered by strings of ``length`` words that stand at two places."""
    raw = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(x[j : j + length]) for _, x in raw for j in range(len(x) - length + 1))
    out = []
    for i, x in raw:
        hit = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            hit[j : j + length] |= seen[tuple(x[j : j + length])] > 1
        out.append((i, int(hit.sum())))
    return sorted(out, key=str)


def result(frame, length):
    from pyspark.sql import functions as F

    out = r.without_repeats(frame, length).select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["a1"] - s["a0"]), F.size("spans"), F.sha2("kept", 256)
    )
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_against_every_window(docs, monkeypatch, hot):
    """With a low HOT nearly every anchor takes the way of hot anchors."""
    monkeypatch.setattr(r, "HOT", hot)
    rows = corpus()
    assert result(docs(rows).repartition(4), 64) == brute(rows, 64)


def test_small_batches_and_pieces(docs, monkeypatch):
    monkeypatch.setattr(r, "BATCH", 3)
    monkeypatch.setattr(r, "PIECE", 100)
    rows = corpus()
    assert result(docs(rows), 64) == brute(rows, 64)


@pytest.mark.parametrize(("piece", "hot"), [(3_000_000, 20_000), (70, 2)])
def test_passages_against_every_window(docs, monkeypatch, piece, hot):
    """Runs of over 20 words that stand elsewhere, however short in bytes; a document without any has none."""
    monkeypatch.setattr(r, "PIECE", piece)
    monkeypatch.setattr(r, "HOT", hot)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 5)))
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 22, 40, 90)]
    rows = []
    for i in range(80):
        parts = [[word() for _ in range(rnd.randint(0, 40))] if rnd.random() < 0.6 else rnd.choice(passages)[rnd.randint(0, 2) :] for _ in range(rnd.randint(1, 5))]
        rows.append((i, rnd.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(100 + i, rows[i][1]) for i in range(4)] + [(200, "same " * 100)] + ODD
    got = r.without_repeats(docs(rows), 400, passage=20).select("doc_id", "n_passage_words").collect()
    want = brute_words(rows, 21)
    assert sorted(map(tuple, got), key=str) == want
    assert any(n == 0 for _, n in want) and any(0 < n < 100 for _, n in want)


def test_length_of_the_query(docs):
    base = "".join(chr(97 + i * i % 26) for i in range(399))
    rows = [(1, base + "A"), (2, base + "A"), (3, base + "B"), (4, "x" + base + "A" + "y")]
    assert result(docs(rows), 400) == brute(rows, 400)
    assert [x[2] for x in result(docs(rows), 400)] == [400, 400, 0, 400]
    assert r.repeats_digest(docs(rows).where("false")).count() == 0


def test_every_window_lies_in_one_segment():
    rnd = np.random.default_rng(1)
    texts = [rnd.integers(97, 100, n, dtype=np.uint8).tobytes() for n in (0, 10, 63, 64, 65, 500, 3000)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    _, s0, s1, place = r.segments(np.frombuffer(b"".join(texts), np.uint8), starts, 64, 32)
    covered = sorted(w for a, b in zip(s0.tolist(), s1.tolist(), strict=True) for w in range(a, b + 1))
    assert covered == [int(a) + j for a, t in zip(starts, texts, strict=False) for j in range(len(t) - 63)]
    assert ((place >= s1) & (place + 32 <= s0 + 64)).all()


def test_prefix_arrays_against_sorting():
    """Which windows repeat, column by column, equals a comparison of all windows of a group at the same offset."""
    rnd, rows = random.Random(8), []
    for g in range(6):
        core = bytes(rnd.choice(b"ab") for _ in range(20))
        for _ in range(rnd.randint(1, 12)):
            off, win = rnd.randint(0, 8), rnd.randint(1, 9)
            left = b"a" * rnd.randint(0, off) + bytes(rnd.choice(b"ab") for _ in range(10))
            data = left[-off:] * (off > 0) + core + bytes(rnd.choice(b"ab") for _ in range(30))
            data = data[: win + 24 - 1]
            rows.append((g, off, win, data))
    found = r.repeated_windows(rows, 24)
    for (g, off, win, data), flags in zip(rows, found, strict=True):
        for j in range(win):
            n = sum(h == g and 0 <= (k := j - off + o) < w and x[k : k + 24] == data[j : j + 24] for h, o, w, x in rows)
            assert bool(flags[j]) == (n > 1)


def test_a_very_long_text(docs):
    rnd = random.Random(3)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(2_000_000))
    rows = [(1, base * 4), (2, base[1000:1400] + "-"), (3, base[1000:1399] + "-")]
    got = {i: (n, gone) for i, n, gone, *_ in result(docs(rows), 400)}
    assert got == {1: (8_000_000, 8_000_000), 2: (401, 400), 3: (400, 0)}
