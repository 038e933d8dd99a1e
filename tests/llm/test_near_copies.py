import random

import pytest

from sketchloom.llm import near_copies as n

from .conftest import ODD


def test_one_of_each(docs):
    frame = docs(ODD)
    kept = n.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(["None", "0", "2", "5", "6", "7"])
    assert n.one_of_each(frame.where("false")).count() == 0


def shingles(t, width=5):
    w = t.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def test_copies_of_a_given_similarity(docs):
    """Edited copies with a similarity over 0.85 fall together, unrelated texts and halves of one text stay."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, groups = [], 0
    for g in range(30):
        base = [word() for _ in range(rnd.choice([150, 300, 600]))]
        rows.append((10 * g, " ".join(base)))
        groups += 1
        for k in range(1, 4):
            copy = list(base)
            for _ in range(max(1, len(base) // 100)):
                copy[rnd.randrange(len(copy))] = word()
            if len(shingles(" ".join(copy)) & shingles(rows[-k][1])) / len(shingles(" ".join(copy)) | shingles(rows[-k][1])) > 0.85:
                rows.append((10 * g + k, " ".join(copy)))
        half = base[: len(base) // 2] + [word() for _ in base[len(base) // 2 :]]
        rows.append((10 * g + 9, " ".join(half)))
        groups += 1
    kept = {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()}
    assert len(rows) > 100 and {i for i, _ in rows if i % 10 in (0, 9)} <= kept
    assert len(kept) <= groups + 2


def edited(rnd, words, k):
    """A copy with k words changed, none within five words of another, so 5 k shingles differ."""
    out = list(words)
    for i in rnd.sample(range(1, len(words) // 5 - 1), k):
        out[5 * i] = f"new{rnd.random()}"
    return out


def brute_kept(rows):
    """The smallest id of each component, all pairs compared by their shingle sets."""
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and top(i) != top(j) and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i for i in sets if top(i) == i}


@pytest.mark.parametrize("sent", [n.KEYS_SENT, 0])
def test_links_are_checked_on_shingles(docs, monkeypatch, sent):
    """Documents of one template that are 0.7 alike all stay; of pairs just over 0.8 alike one goes, of those just under none. With keys sent and with keys shuffled."""
    monkeypatch.setattr(n, "KEYS_SENT", sent)
    rnd = random.Random(8)
    base = [f"t{i}" for i in range(304)]
    rows = [(i, " ".join(edited(rnd, base, 5))) for i in range(150)]
    for g in range(100):
        text = [f"g{g}w{i}" for i in range(304)]
        rows += [(1000 + 10 * g, " ".join(text)), (1001 + 10 * g, " ".join(edited(rnd, text, 6))), (1002 + 10 * g, " ".join(edited(rnd, text, 7)[::-1]))]
        rows += [(1003 + 10 * g, " ".join(edited(rnd, text[::-1], 7)))]
    want = brute_kept(rows)
    assert len(want & set(range(150))) > 140 and not any(1001 + 10 * g in want for g in range(100))
    assert {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()} == want


def test_all_members_of_a_bucket_are_compared(docs, monkeypatch):
    """Near copies amid many texts of their template are found whatever their places in the buckets, in one block or in several."""
    rnd = random.Random(9)
    base = [f"t{i}" for i in range(304)]
    texts = [edited(rnd, base, 6) for _ in range(250)]
    texts += [edited(rnd, t, 6) for t in texts[:60]]
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute_kept(rows)
    assert 240 <= len(want) <= 255
    for size in (n.BLOCK, 20):
        monkeypatch.setattr(n, "BLOCK", size)
        monkeypatch.setattr(n, "PART", 2 * size)
        assert {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()} == want


def test_links_of_a_group_are_not_spelled_out(docs, monkeypatch):
    """Strays of a large group of near copies ask in proportion to the group, not to its links; the rows kept are those of a comparison of all pairs."""
    rnd = random.Random(2)
    base = [f"t{i}" for i in range(304)]
    rows = [(i, " ".join(edited(rnd, base, rnd.choice([1, 3, 5, 5, 5])))) for i in range(300)]
    rows += [(300 + i, " ".join(edited(rnd, base, 8))) for i in range(40)]
    asked, alike = [], n.alike
    monkeypatch.setattr(n, "alike", lambda d, c, a, *w: asked.append(a.count()) or alike(d, c, a, *w))
    assert {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()} == brute_kept(rows)
    assert sum(asked) < 5 * len(rows)


def test_strays_ask_until_none_is_left(docs, monkeypatch):
    """Texts that are just under 0.8 alike, so that parities rule none out, are all asked in rounds of any size, and only those 0.8 alike fall together."""
    rnd = random.Random(11)
    base, places = [f"t{i}" for i in range(989)], rnd.sample(range(1, 196), 176)
    texts = []
    for i in range(48):
        text = list(base)
        for p in places[i % 16 * 11 : i % 16 * 11 + 11]:
            text[5 * p] = f"new{rnd.random()}"
        texts.append(" ".join(text))
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_kept(rows)
    assert len(want) == 16
    asked, alike = [], n.alike
    monkeypatch.setattr(n, "alike", lambda d, c, a, *w: asked.append(a.count()) or alike(d, c, a, *w))
    for k in (1, n.NEAREST):
        monkeypatch.setattr(n, "NEAREST", k)
        monkeypatch.setattr(n, "GROWTH", 4 * k)
        monkeypatch.setattr(n, "PAIRS", 50 * k)
        asked.clear()
        assert {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()} == want
        assert len(asked) > 2 and sum(asked) > 300


def test_groups_of_sorted_batches():
    pa = n.pa
    key, value = [1, 1, 1, 2, 3, 3, 5], list(range(7))
    batches = lambda size: (pa.RecordBatch.from_arrays([pa.array(key[i : i + size], pa.int64()), pa.array(value[i : i + size])], ["k", "v"]) for i in range(0, 7, size))
    for size in (1, 2, 3, 7):
        assert [g.column("v").to_pylist() for g in n.groups_of(batches(size), ("k",))] == [[0, 1, 2], [3], [4, 5], [6]]
    assert list(n.groups_of(iter([]), ("k",))) == []


def test_heavy_shingles_come_later(docs, monkeypatch):
    """A passage that many texts share goes to the end of the order after a look at the buckets; the rows kept are the same."""
    rnd = random.Random(3)
    common = " ".join(f"c{i}" for i in range(30))
    rows = [(i, " ".join(f"w{rnd.random()}" for _ in range(60)) + " " + common) for i in range(80)]
    rows += [(100 + i, t + " end") for i, t in rows[:20]]
    monkeypatch.setattr(n, "SAMPLE", 1)  # the sample knows nothing
    want = {i for i, _ in rows if i < 100}
    assert {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()} == want
    monkeypatch.setattr(n, "HEAVY", 30)
    assert {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()} == want
    order = n.np.zeros(0, n.np.int64), n.np.zeros(0, n.np.int64)
    most = []
    while order is not None:
        shared = n.shared_shingles(n.classes_of(docs(rows), 5, order))
        most.append(shared.agg(n.F.max("m")).first()[0])
        order = n.with_heavy(order, shared)
    assert 2 <= len(most) <= n.LOOKS + 2 and most[0] > 30 >= most[-1]


def test_class_ids_that_fall_together(docs, monkeypatch):
    """Different sets under one id are told apart by their second hash: none is lost as a copy of the other."""
    import xxhash

    first = xxhash.xxh3_64_intdigest
    monkeypatch.setattr(n, "described", lambda d, w, o, f=n.described: f(d, w, o).withColumn("id", n.F.lit(5).cast("long")))
    rows = [(i, f"text number {i} " + "word " * i) for i in range(20)] + [(100 + i, f"text number {i} " + "word " * i) for i in range(20)]
    assert {r["doc_id"] for r in n.one_of_each(docs(rows)).collect()} >= set(range(20))
    assert xxhash.xxh3_64_intdigest is first


def test_tables_in_between_are_deleted(docs, spark):
    import os

    from sketchloom.sources.shared import shared_dir

    frame = docs([(i, f"one text of {i % 7} and some more words") for i in range(50)])
    before = set(os.listdir(shared_dir(spark).removeprefix("file:"))) if os.path.isdir(shared_dir(spark).removeprefix("file:")) else set()
    assert n.one_of_each(frame).count() == 7
    left = {f.rpartition("-")[0] for f in set(os.listdir(shared_dir(spark).removeprefix("file:"))) - before}
    assert not left & {"near-classes", "near-met", "near-shared", "near-sets", "near-rows", "near-named"}
