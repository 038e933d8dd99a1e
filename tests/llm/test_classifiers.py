"""Toxicity and quality: the parts against plain versions, and accuracy on rows that were held out."""

import itertools
import random
import zlib

import numpy as np
import pytest

from sketchloom.llm import quality, toxicity
from sketchloom.llm.common import fit_logistic, labelled_sample, table
from sketchloom.llm.queries import op6_quality, op10_toxicity

from .conftest import ODD


def all_labellings(emit, trans, start):
    """Marginals and expected transitions of one chain by summing over all its labellings."""
    n, p, pairs, z = len(emit), np.zeros(len(emit)), np.zeros((2, 2)), 0.0
    for y in itertools.product((0, 1), repeat=n):
        w = np.exp(start * y[0] + sum(e * v for e, v in zip(emit, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))) if n else 1.0
        z += w
        p += w * np.array(y, float)
        for a, b in zip(y, y[1:], strict=False):
            pairs[a, b] += w
    return p / z, pairs / z


@pytest.mark.parametrize("block", [1, 2, 3, 64])
def test_marginals_against_all_labellings(monkeypatch, block):
    """Whatever the block, the marginals are those of whole texts."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 1, 8, 2, 3, 0, 7])
    emit, trans, start = 2 * rng.normal(size=sizes.sum()), rng.normal(size=(2, 2)), 0.7
    p, pairs = toxicity.marginals(emit, toxicity.Chains(sizes), trans, start, pairs=True)
    want = [all_labellings(part, trans, start) for part in np.split(emit, np.cumsum(sizes)[:-1])]
    assert np.allclose(p, np.concatenate([x for x, _ in want])) and np.allclose(pairs, sum(x for _, x in want))


def test_gradient_is_that_of_the_likelihood():
    """Against differences of the log-likelihood, computed over all labellings."""
    rng = np.random.default_rng(4)
    sizes = np.array([4, 1, 6])
    chains, n = toxicity.Chains(sizes), int(sizes.sum())
    own, before, after = [rng.integers(0, 4, n) for _ in range(2)], rng.integers(0, 3, n), rng.integers(0, 3, n)
    label = rng.integers(0, 2, n).astype(bool)
    data = own, before, after, chains, label.astype(float), toxicity._real(label, chains)
    weights = [rng.normal(size=4), rng.normal(size=3), rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2)]
    for w in weights[:3]:
        w[0] = 0.0

    def likelihood(ws):
        wf, wb, wa, trans, extra = ws
        emit, total = sum(wf[o] for o in own) + wb[before] + wa[after] + extra[1], 0.0
        score = lambda e, y: extra[0] * y[0] + sum(a * v for a, v in zip(e, y, strict=True)) + sum(trans[a, b] for a, b in zip(y, y[1:], strict=False))
        for e, y in zip(np.split(emit, np.cumsum(sizes)[:-1]), np.split(label.astype(int), np.cumsum(sizes)[:-1]), strict=True):
            total += score(e, y.tolist()) - np.log(sum(np.exp(score(e, z)) for z in itertools.product((0, 1), repeat=len(e))))
        return total

    for k, g in enumerate(toxicity.objective_gradient(weights, data)):
        for i in np.ndindex(g.shape):
            if k < 3 and i == (0,):
                continue
            ends = []
            for d in (1e-5, -1e-5):
                moved = [w.copy() for w in weights]
                moved[k][i] += d
                ends.append(likelihood(moved))
            assert g[i] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-5)


def test_telling_against_sets():
    rng = np.random.default_rng(5)
    words, before, toxic = rng.integers(0, 12, 600), rng.integers(0, 30, 600), (rng.random(600) < 0.1).astype(int)
    toxic[words == 3] = 1
    toxic[words == 7] = 1
    features = np.array([[1 + w, 20 + w // 4 if w % 2 else 0, 0, 0, 40] for w in range(12)])
    got = set(np.flatnonzero(toxicity.telling(words, before, toxic, features)).tolist())
    least, want = max(4.0, np.log(toxicity.TELLING_CHANCE) / np.log(toxic.mean())), set()
    for f in range(1, 30):
        pairs = [{(w, b) for w, b, t in zip(words, before, toxic, strict=True) if t == c and f in features[w, :4]} for c in (0, 1)]
        if len(pairs[1]) >= least and len(pairs[1]) >= toxicity.TELLING_SHARE * (len(pairs[0]) + len(pairs[1])):
            want.add(f)
    assert got == want and want >= {4, 8}


def test_blocks_cover_every_word():
    chains = toxicity.Chains(np.array([0, 1, 64, 65, 200]))
    words = sorted(w for a, n in zip(chains.begin, chains.length, strict=True) for w in range(a, a + n))
    assert words == list(range(330)) and max(chains.length) <= toxicity.BLOCK and chains.opens.sum() == 4


def test_document_scores():
    """Words weigh what their features do, the sum of the squared marginals is the evidence."""
    model = toxicity.Field(weights={"w": {"vile": 2.5}, "b4": {"scum": 2.0}, "e": {"bag": 0.5}}, before={"you": 1.5}, after={"go": 1.0}, trans=np.array([[0.0, -1.0], [-0.5, 2.0]]), start=-3.0, bias=-3.0)
    texts = ["You (scumbag) go, vile!", "", "scum", "fine  words\tgo"]
    emits = [[-3, -3 + 2.0 + 0.5 + 1.5 + 1.0, -3, -3 + 2.5], [], [-3], [-3, -3 + 1.0, -3]]
    for (n, p), e in zip(toxicity.Tagger(model)(texts), emits, strict=True):
        want = all_labellings(e, model.trans, model.start)[0]
        assert np.allclose(p, want) and n == pytest.approx(np.square(want).sum())


def sample(n=400):
    rnd = random.Random(1)
    plain = [f"w{rnd.randrange(3000)}" for _ in range(4000)]
    rows = []
    for i in range(n):
        ws = [rnd.choice(plain) for _ in range(60)]
        if i % 2:
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(["scumbag", "vileness", "Scumbag,"]))
        rows.append((" ".join(ws), i % 2))
    return rows


def test_toxic_spans_and_scores(docs):
    model = toxicity.fit(sample())
    rows = {r["doc_id"]: r for r in toxicity.tag(docs([(1, "fine words é here"), (2, "you 😀 Scumbag, go"), *[(10 + i, t) for i, (_, t) in enumerate(ODD)]]), model).collect()}
    assert rows[2]["score"] > 0.5 > rows[1]["score"] and rows[10]["score"] < 0.5
    assert [("you 😀 Scumbag, go"[s["start"] : s["end"]], s["p"] > 0.5) for s in rows[2]["spans"]] == [("Scumbag,", True)]
    kept = toxicity.clean_only(docs([(1, "fine"), (2, "Scumbag vileness"), (3, None)]), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3] and kept.first()["label"] == "clash"


def test_a_very_long_text(docs):
    model = toxicity.fit(sample())
    text = "plain words of a text " * 1_000_000 + "scumbag"
    rows = toxicity.tag(docs([(1, text), (2, text[:-7])]), model).collect()
    assert {r["doc_id"]: len(r["spans"]) for r in rows} == {1: 1, 2: 0}


def test_one_class_or_none(docs):
    assert toxicity.tag(docs([(1, "x")]), toxicity.fit([])).first()["score"] < 1e-6
    assert toxicity.tag(docs([(1, "x")]), toxicity.fit([("a", 1), ("b", 1)])).first()["score"] > 0.99
    model, ratio = quality.fit([])
    assert quality.scores(docs([(1, "x")]), model, ratio).first()["score"] == pytest.approx(0.5)


def test_dual_descent_separates():
    rng = np.random.default_rng(2)
    rows, sign = [], []
    for i in range(60):
        y = 1 if i % 2 else -1
        rows.append((np.array([0, 1]), np.array([y * 2 + rng.normal() * 0.3, rng.normal()])))
        sign.append(float(y))
    w = quality.dual_descent(rows, np.array(sign), np.ones(60))
    assert all(s * (w[at] @ v) > 0 for (at, v), s in zip(rows, sign, strict=True))


def test_log_count_ratio_against_counting():
    """Naive Bayes ratios of the query's own features, by counting in plain dictionaries."""
    texts = [("one two two three", 1), ("one two", 0), ("", 1), ("Three! three? 4 4 4", 0), ("one two two three", 1)]
    words = quality.Words()
    with np.errstate(over="ignore"):
        sets = [quality.features(t, words) for t, _ in texts]
    ratio = quality.log_count_ratio(sets, np.array([c for _, c in texts]))
    counts = [{}, {}]
    for f, (_, c) in zip(sets, texts, strict=True):
        for k in f.tolist():
            counts[c][k] = counts[c].get(k, 0) + 1
    totals = [sum(n.values()) + 2**quality.BITS for n in counts]
    for k in {k for n in counts for k in n} | {5}:
        assert ratio[k] == pytest.approx(np.log((counts[1].get(k, 0) + 1) / totals[1]) - np.log((counts[0].get(k, 0) + 1) / totals[0]))


def test_dual_descent_reaches_the_optimum():
    """The duality gap closes: the hinge objective at the weights equals the dual at the multipliers that give them."""
    rng = np.random.default_rng(6)
    x, sign, cost = rng.normal(size=(20, 3)), np.where(rng.random(20) < 0.5, 1.0, -1.0), rng.uniform(0.2, 2.0, 20)
    w = quality.dual_descent([(np.arange(3), v) for v in x], sign, cost, epochs=3000)[:3]
    primal = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best = primal(w)
    for _ in range(2000):
        assert primal(w + rng.normal(size=3) * 10 ** rng.uniform(-6, 0)) >= best - 1e-9
    alpha = np.zeros(20)
    for _ in range(3000):  # projected dual ascent of its own
        grad = 1 - sign * (x @ ((alpha * sign) @ x))
        alpha = np.clip(alpha + 0.01 * grad, 0, cost)
    dual = alpha.sum() - np.square((alpha * sign) @ x).sum() / 2
    assert best == pytest.approx(dual, rel=1e-3)


def test_sample_is_the_same_in_every_run(spark):
    """Ids with both labels are left out; of several texts under an id always the same one is taken."""
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, None), (2, "c"), (3, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = [labelled_sample(docs.repartition(n), labels, "toxic", 100, 99, {0: 5, 1: 5}) for n in (1, 3, 5)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 2 and got[0][1] == ("d", 0)


def test_logistic_recovers_a_curve():
    rng = np.random.default_rng(3)
    x = rng.normal(size=5000)
    y = (rng.random(5000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    a, b = fit_logistic(x, y)
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2


def test_sample_is_bounded_and_leaves_out_the_fold(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = labelled_sample(docs.select("doc_id", docs["doc_id"].cast("string").alias("text")), labels, "quality", 3, 1, {0: 4, 1: 9})
    assert len(rows) <= 13 and all(zlib.crc32(t.encode()) % 3 != 1 for t, _ in rows)


@pytest.mark.parametrize("run, label, least, recall, precision", [(op6_quality, "quality", 0.95, 0.95, 0.95), (op10_toxicity, "toxic", 0.92, 0.6, 0.9)])
def test_held_out_accuracy(spark, run, label, least, recall, precision):
    big = "/root/testdata/sf0.01"
    scored = run(spark, big).join(table(spark, big, "labels"), "doc_id").where("held_out").collect()
    right = [r["predicted"] == r[label] for r in scored]
    assert len(right) > 50 and sum(right) / len(right) >= least
    assert all(0 <= r["score"] <= 1 for r in scored)
    hits = sum(r["predicted"] == r[label] == 1 for r in scored)
    assert hits >= recall * sum(r[label] for r in scored) and hits >= precision * sum(r["predicted"] for r in scored)


def test_odd_rows(spark, docs, sf_dir):
    labels = table(spark, sf_dir, "labels")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        rows = f(docs(ODD), labels).collect()
        assert len(rows) == len(ODD) and all(r["score"] is not None and r["held_out"] is not None for r in rows)
        assert f(docs(ODD).where("false"), labels.where("false")).count() == 0
