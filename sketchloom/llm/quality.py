"""Quality classifier: naive Bayes support vectors.

A text is a set of n-gram indicators: words and word pairs, n-grams of word shapes, n-grams of whether neighbouring words repeat, and
the share of each shape in powers of two. Each indicator is scaled by the class log-count ratio of naive Bayes, texts are
brought to unit length, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve, fitted on a part of the
sample that the model has not seen, turns margins into scores.

Labels are read from a bounded sample of labelled rows (PER_CLASS rows per class) outside the held-out fold; texts are used whole, and nothing but the text enters a
score. A null text counts as empty and is scored like any other; with no labels or one class only, every score is that
class's share (0.5 without labels). Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, fold_of, give_back, labelled_sample, sigmoid, slices_of

PER_CLASS = {0: 2000, 1: 3000}
BITS = 18
MASK = np.uint64(2**BITS - 1)
CACHED = 200_000
SLICE = 2_000_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(word: str) -> str:
    """Case and the marks around a word."""
    core = word.strip("".join(sorted(set(word) - set(filter(str.isalnum, word)))))
    at = word.find(core) if core else 0
    marks = (word[:at][:2] + "_" + word[at + len(core) :][:3]) if core else word[:4]
    kind = "none" if not core else "low" if core.islower() else "up" if core.isupper() and len(core) > 1 else "title" if core.istitle() else "num" if core.isdigit() else "mix"
    return f"{kind} {marks} {min(len(core) // 6, 3)}"


class Words:
    """Hashes of words and shapes, remembered within bounds."""

    def __init__(self):
        self.known: dict[str, tuple[int, int]] = {}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > CACHED:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = (zlib.crc32(w.lower().encode()), zlib.crc32(b"shape " + shape(w).encode()))
        pairs = np.array([self.known[w] for w in words], dtype=np.uint64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def grams(stream: np.ndarray, n: int, salt: int) -> np.ndarray:
    if len(stream) < n:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(len(stream) - n + 1, salt, dtype=np.uint64)
    for i in range(n):
        h = (h * _B + stream[i : len(stream) - n + 1 + i]) * _A
        h ^= h >> np.uint64(29)
    return h


def features(text: str | None, words: Words) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    tokens = (text or "").split()
    word, kind = words(tokens)
    same = (word[1:] == word[:-1]).astype(np.uint64) if len(word) else word
    parts = [grams(word, n, n) for n in (1, 2)] + [grams(kind, n, 10 + n) for n in (1, 2, 3)] + [grams(same, n, 20 + n) for n in (1, 3)]
    if len(tokens):
        values, counts = np.unique(kind, return_counts=True)
        level = np.floor(-np.log2(counts / len(tokens)) * 2).astype(np.uint64)
        parts.append(grams(values * np.uint64(64) + level, 1, 31))
        parts.append(grams(np.array([min(9, int(10 * same.mean()) if len(same) else 0), len(tokens).bit_length() + 20, 40 + int(10 * len(set(tokens)) / len(tokens))], dtype=np.uint64), 1, 32))
    parts.append(np.full(1, 7, dtype=np.uint64))
    return np.unique(np.concatenate(parts) & MASK).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    intercept: float

    def score(self, found: np.ndarray, ratio: np.ndarray) -> float:
        return float(sigmoid(self.slope * margin(found, self.weights, ratio) + self.intercept))


def margin(found: np.ndarray, weights: np.ndarray, ratio: np.ndarray) -> float:
    norm = np.sqrt(np.square(ratio[found]).sum())
    return float((weights[found] * ratio[found]).sum() / max(norm, 1e-9))


def log_count_ratio(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = [np.bincount(np.concatenate([s for s, c in zip(sets, y, strict=True) if c == k]), minlength=2**BITS) + 1.0 for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + sum of cost * hinge over rows of (features, values), by dual coordinate descent."""
    w, alpha, rng = np.zeros(2**BITS), np.zeros(len(rows)), np.random.default_rng(seed)
    norm = np.array([np.square(v).sum() for _, v in rows])
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            gradient = sign[i] * (w[at] @ v) - 1.0
            fresh = min(max(alpha[i] - gradient / max(norm[i], 1e-9), 0.0), cost[i])
            if fresh != alpha[i]:
                w[at] += (fresh - alpha[i]) * sign[i] * v
                alpha[i] = fresh
    return w


def fit(sample: list[tuple[str, int]]) -> tuple[Model, np.ndarray]:
    y = np.array([c for _, c in sample], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Model(np.zeros(2**BITS), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))), np.zeros(2**BITS)
    words = Words()
    with np.errstate(over="ignore"):
        sets = [features(t, words) for t, _ in sample]
    learn = np.arange(len(y)) % 5 != 0
    if len(set(y[learn].tolist())) < 2 or len(set(y[~learn].tolist())) < 2:
        learn[:] = True
    ratio = log_count_ratio([s for s, k in zip(sets, learn, strict=True) if k], y[learn])
    rows = []
    for i in np.flatnonzero(learn):
        v = ratio[sets[i]]
        rows.append((sets[i], v / max(np.sqrt(np.square(v).sum()), 1e-9)))
    own = y[learn]
    cost = np.where(own == 1, len(own) / (2 * (own == 1).sum()), len(own) / (2 * (own == 0).sum()))
    weights = dual_descent(rows, np.where(own == 1, 1.0, -1.0), cost)
    check = ~learn if (~learn).any() else learn
    x = np.array([margin(sets[i], weights, ratio) for i in np.flatnonzero(check)])
    return Model(weights, *fit_logistic(x, y[check])), ratio


def scores(docs: DataFrame, model: Model, ratio: np.ndarray) -> DataFrame:
    """doc_id, score, one row per document."""
    m = Model(model.weights.astype(np.float32), model.slope, model.intercept)
    r = ratio.astype(np.float32)

    def run(batches):
        words = Words()
        with np.errstate(over="ignore"):
            for b in slices_of(batches, SLICE):
                out = [m.score(features(t, words), r) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """The columns of query op6."""
    model, ratio = fit(labelled_sample(docs, labels, "quality", modulus, held_out, PER_CLASS))
    give_back()
    return scores(docs, model, ratio).select(
        "doc_id", (fold_of(modulus) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
