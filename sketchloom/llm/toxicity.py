"""Toxicity: a linear-chain conditional random field tags toxic words, and its marginals become document scores and spans.

Labels are given by document only, so labelled tokens are made first: in a bounded sample of labelled documents, a word or word beginning is
telling if it follows many different words in toxic documents (copies of a document count once so) and hardly any in clean
ones; words with a telling feature are labelled toxic where they stand in toxic documents. The field then learns from all words of the sample: word, beginnings, ending, and the
words on either side are its features, and transitions its memory.

A text is one chain from its first word to its last. Forward-backward runs over blocks of its words side by side: the product of a block's transitions carries the
messages from block to block, so every marginal is that of the whole text. The sum of the squared marginals (so that many faint ones do not
add up to a toxic word) gives a document's score through a logistic curve fitted on documents.

The sample is bounded by rows (PER_CLASS, whole texts). Features are kept by name, so the model is as large as the sample's vocabulary at most. Nothing but the text enters a score. A null
text counts as empty: no words, the score of no toxic words. Without labels of both classes every score is that class's share (0
without labels). Repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_logistic, fold_of, give_back, labelled_sample, sigmoid, slices_of

PER_CLASS = {0: 2000, 1: 700}
BLOCK = 64
MARKS = ".,!?;:|*#%&$\"'()[]{}<>-_/\\"
CACHED = 80_000
SLICE = 1_500_000
TELLING_CHANCE = 1e-7
TELLING_SHARE = 0.95
LEAST_SEEN = 3
ROUNDS = 60
WORD = re.compile(r"\S+")
#: Features of a word on its own: the word, beginnings of words that are longer, the ending.
KINDS = ("w", "b4", "b5", "b6", "e")


def cores(words: list[str]) -> pa.Array:
    """Words without the marks around them, in lower case."""
    return pc.utf8_lower(pc.utf8_trim(pa.array(words, pa.string()), characters=MARKS))


def features_of(core: pa.Array) -> dict[str, pa.Array]:
    """By kind the feature of each word, null where it has none."""
    size = pc.utf8_length(core)
    out = {"w": core}
    for n in (4, 5, 6):
        out[f"b{n}"] = pc.if_else(pc.greater(size, n), pc.utf8_slice_codeunits(core, 0, n), pa.scalar(None, pa.string()))
    return out | {"e": pc.utf8_slice_codeunits(core, -3)}


@dataclass
class Field:
    """weights: by kind of the features for the label toxic against clean; before, after: of a neighbour's word; trans[i, j]: from label i to j;
    start: of toxic at the beginning of a text."""

    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    bias: float = 0.0
    slope: float = 0.0
    intercept: float = -20.0


class Chains:
    """Where the words of texts stand that lie one after another, ``sizes`` words each: in blocks of at most BLOCK words, longer blocks first."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        self.total = int(sizes.sum())
        count = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        length = np.minimum(BLOCK, sizes[of] - nth * BLOCK)
        order = np.argsort(-length, kind="stable")
        self.nth, self.length = nth[order], length[order]
        self.begin = ((np.cumsum(sizes) - sizes)[of] + nth * BLOCK)[order]
        self.active = np.searchsorted(-self.length, -np.arange(BLOCK), side="left")  # blocks longer than each place
        self.first = self.nth == 0
        by = np.argsort(self.nth, kind="stable")
        edges = np.searchsorted(self.nth[by], np.arange(self.nth.max(initial=-1) + 2))
        text = of[order]
        where = np.full((len(sizes),), -1)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []  # for each further block of a text: the one before, and itself
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            here = by[lo:hi]
            if k:
                self.steps.append((where[text[here]], here))
            where[text[here]] = here
        self.opens = np.zeros(self.total, dtype=bool)  # first words of texts
        self.opens[(np.cumsum(sizes) - sizes)[sizes > 0]] = True


def marginals(emit: np.ndarray, chains: Chains, trans: np.ndarray, start: float, pairs: bool = False):
    """P(toxic) at every word of texts; with pairs also the expected transition counts. Messages are scaled to sum to one, and given by the part of the label toxic."""
    n = len(chains.begin)
    e = np.exp(np.clip(emit, -30, 30))
    t = np.exp(trans)
    s = np.exp(start)
    at = lambda i, m: e[chains.begin[:m] + i]
    # from either label (row) to the label after a block (column)
    p00, p01, p10, p11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    for i, m in enumerate(chains.active.tolist()):
        if not m:
            break
        t00, t01, t10, t11 = t[0, 0], t[0, 1], t[1, 0], t[1, 1]
        if i == 0:  # into the first word of a text there is no transition
            f = chains.first
            t00, t10 = np.where(f, 1.0, t00), np.where(f, 1.0, t10)
            t01, t11 = np.where(f, s, t01), np.where(f, s, t11)
        x = at(i, m)
        a, b, c, d = p00[:m], p01[:m], p10[:m], p11[:m]
        q = a * t00 + b * t10, (a * t01 + b * t11) * x, c * t00 + d * t10, (c * t01 + d * t11) * x
        z = 1.0 / (q[0] + q[1] + q[2] + q[3])
        p00[:m], p01[:m], p10[:m], p11[:m] = q[0] * z, q[1] * z, q[2] * z, q[3] * z
    into, out = np.full(n, 0.5), np.full(n, 0.5)
    for was, here in chains.steps:
        a = into[was]
        one, nil = (1 - a) * p01[was] + a * p11[was], (1 - a) * p00[was] + a * p10[was]
        into[here] = one / (one + nil)
    for was, here in reversed(chains.steps):
        b = out[here]
        one, nil = p10[here] * (1 - b) + p11[here] * b, p00[here] * (1 - b) + p01[here] * b
        out[was] = one / (one + nil)
    a1, b1 = np.empty(chains.total), np.empty(chains.total)
    a = into
    for i, m in enumerate(chains.active.tolist()):
        if not m:
            break
        a = a[:m]
        one, nil = (a * t[1, 1] + (1 - a) * t[0, 1]), a * t[1, 0] + (1 - a) * t[0, 0]
        if i == 0:
            one, nil = np.where(chains.first, s, one), np.where(chains.first, 1.0, nil)
        one = one * at(i, m)
        a = one / (one + nil)
        a1[chains.begin[:m] + i] = a
    b = out.copy()
    for i in range(BLOCK - 1, -1, -1):
        m = int(chains.active[i])
        if not m:
            continue
        b1[chains.begin[:m] + i] = b[:m]
        if i:
            x, y = at(i, m), b[:m]
            one, nil = t[1, 1] * x * y + t[1, 0] * (1 - y), t[0, 1] * x * y + t[0, 0] * (1 - y)
            b[:m] = one / (one + nil)
    p = a1 * b1 / (a1 * b1 + (1 - a1) * (1 - b1))
    if not pairs:
        return p
    inner = ~chains.opens[1:]
    left, right = (1 - a1[:-1][inner], a1[:-1][inner]), (1 - b1[1:][inner], (e * b1)[1:][inner])
    both = sum(left[j] * right[k] * t[j, k] for j in (0, 1) for k in (0, 1))
    return p, np.array([[(left[j] * right[k] / both).sum() * t[j, k] for k in (0, 1)] for j in (0, 1)])


def telling(words: np.ndarray, before: np.ndarray, toxic: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Which features have pairs with different words before them that lie in toxic documents to TELLING_SHARE at least, and so many of them that chance
    would put them there with a probability of TELLING_CHANCE at most. features: numbers by (word, kind), 0 for none; endings are not asked."""
    counts = np.zeros((2, int(features.max(initial=0)) + 1))
    for c in (0, 1):
        pairs = np.unique(np.stack([words[toxic == c], before[toxic == c]]), axis=1)[0]
        seen = np.bincount(pairs, minlength=len(features))
        for j in range(len(KINDS) - 1):
            counts[c] += np.bincount(features[:, j], seen, counts.shape[1])
    least = max(4.0, np.log(TELLING_CHANCE) / np.log(max(toxic.mean(), 1e-3)))
    out = (counts[1] >= least) & (counts[1] >= TELLING_SHARE * counts.sum(axis=0))
    out[0] = False
    return out


def numbered(core: pa.Array) -> tuple[np.ndarray, list[tuple[str, pa.Array]]]:
    """(word, kind) numbers from 1 of the features, 0 for none; and their names in that order, by kind."""
    table, names, size = np.zeros((len(core), len(KINDS)), dtype=np.int64), [], 0
    for j, (kind, column) in enumerate(features_of(core).items()):
        coded = column.dictionary_encode()
        index = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        table[:, j] = np.where(index >= 0, index + 1 + size, 0)
        names.append((kind, coded.dictionary))
        size += len(coded.dictionary)
    return table, names


def neighbours(ids: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 of the words before and after each, 0 at the ends of texts."""
    before, after = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
    before[1:], after[:-1] = np.where(opens[1:], 0, ids[:-1] + 1), np.where(opens[1:], 0, ids[1:] + 1)
    return before, after


def objective_gradient(weights: list[np.ndarray], data: tuple) -> list[np.ndarray]:
    """Gradient of the log-likelihood of the labels by (features, before, after, transitions, start and bias)."""
    own, before, after, chains, truth, real = data
    wf, wb, wa, trans, extra = weights
    emit = sum((wf[o] for o in own), wb[before] + wa[after] + extra[1])
    p, expected = marginals(emit, chains, trans, extra[0], pairs=True)
    off = truth - p
    gradients = [
        sum(np.bincount(o, off, len(wf)) for o in own), np.bincount(before, off, len(wb)), np.bincount(after, off, len(wa)),
        real - expected, np.array([off[chains.opens].sum(), off.sum()]),
    ]
    gradients[0][0] = gradients[1][0] = gradients[2][0] = 0.0
    return gradients


def fit(sample: list[tuple[str, int]]) -> Field:
    seen: set[str] = set()
    rows = [(t, c) for t, c in sample if not (t in seen or seen.add(t))]
    y = np.array([c for _, c in rows], dtype=np.int64)
    model = Field()
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        model.intercept = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return model
    number: dict[str, int] = {}
    listed = [np.array([number.setdefault(w, len(number)) for w in t.split()], dtype=np.int64) for t, _ in rows]
    sizes = np.array([len(x) for x in listed])
    if not sizes.sum():
        return model
    coded = cores(list(number)).dictionary_encode()
    core, words = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)[np.concatenate(listed)].astype(np.int64)
    del number, listed
    chains = Chains(sizes)
    table, names = numbered(core)
    toxic = np.repeat(y, sizes)
    before, after = neighbours(words, chains.opens)
    marks = telling(words, before, toxic, table)
    toxic_word = marks[table].any(axis=1) & (pc.utf8_length(core).to_numpy(zero_copy_only=False) > 2)
    label = toxic_word[words] & (toxic == 1)
    often = np.zeros(sum(len(d) for _, d in names) + 1)
    seen_words = np.bincount(words, minlength=len(core))
    for j in range(len(KINDS)):
        often += np.bincount(table[:, j], seen_words, len(often))
    often[0] = 0
    used = often >= LEAST_SEEN
    table = (np.cumsum(used) * used)[table].astype(np.int32)
    edges = np.cumsum([1, *(len(d) for _, d in names)])
    kept_names = [(kind, d.filter(pa.array(used[a:b]))) for (kind, d), a, b in zip(names, edges, edges[1:], strict=False)]
    del names, toxic, marks
    data = ([table[words, j] for j in range(len(KINDS))], before, after, chains, label.astype(float), _real(label, chains))
    weights = [np.zeros(int(used.sum()) + 1), np.zeros(len(core) + 1), np.zeros(len(core) + 1), np.zeros((2, 2)), np.zeros(2)]
    weights[4][1] = np.log((label.sum() + 1) / (len(label) + 1))  # as rare as toxic words are; the features make up for it
    sums = [np.full_like(x, 1e-6) for x in weights]
    scale = 1.0 / max(1.0, float(label.sum()))
    for _ in range(ROUNDS):
        for w, g, s, ridge in zip(weights, objective_gradient(weights, data), sums, (2e-3, 2e-2, 2e-2, 1e-3, 1e-4), strict=True):
            g = g * scale - ridge * w * scale
            s += g * g
            w += 0.5 * g / np.sqrt(s)
    del data, words, label, before, after, chains, table
    wf, wb, wa, model.trans, extra = weights
    keep_at = 0.02
    at = 1
    for kind, d in kept_names:
        model.weights[kind] = {name: x for name, x in zip(d.to_pylist(), wf[at : at + len(d)].tolist(), strict=True) if abs(x) > keep_at}
        at += len(d)
    listed = core.to_pylist()
    model.before = {w: x for w, x in zip(listed, wb[1:].tolist(), strict=True) if abs(x) > keep_at}
    model.after = {w: x for w, x in zip(listed, wa[1:].tolist(), strict=True) if abs(x) > keep_at}
    model.start, model.bias = float(extra[0]), float(extra[1])
    tag = Tagger(model)
    x = np.concatenate([evidence(tag(part)) for part in ([t for t, _ in rows[i : i + 200]] for i in range(0, len(rows), 200))])
    model.slope, model.intercept = fit_logistic(x, y)
    return model


def _real(label: np.ndarray, chains: Chains) -> np.ndarray:
    """Transition counts of the labels."""
    inner = ~chains.opens[1:]
    return np.bincount(2 * label[:-1][inner] + label[1:][inner], minlength=4).reshape(2, 2).astype(float)


def evidence(found: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Logarithm of the sum of the squared marginals."""
    return np.log(np.array([n for n, _ in found]) + 1e-2)


class Weights:
    """What names weigh, looked up for whole arrays."""

    def __init__(self, named: dict[str, float]):
        self.names, self.values = pa.array(list(named), pa.string()), np.array([*named.values(), 0.0])

    def __call__(self, column: pa.Array) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(column))
        at = pc.index_in(column, value_set=self.names, skip_nulls=True)
        return self.values[pc.fill_null(at, len(self.names)).to_numpy(zero_copy_only=False)]


class Tagger:
    """Marginals of whole texts under a model; the numbers of words are remembered within bounds, what they weigh stands in arrays."""

    def __init__(self, model: Field):
        self.model = model
        self.kinds = {k: Weights(model.weights.get(k, {})) for k in KINDS}
        self.sides = Weights(model.before), Weights(model.after)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.table = np.zeros((3, 0))

    def learn(self, fresh: list[str]) -> None:
        core = cores(fresh)
        own = sum(self.kinds[k](column) for k, column in features_of(core).items())
        self.table = np.concatenate([self.table, np.stack([own, self.sides[0](core), self.sides[1](core)])], axis=1)
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))

    def __call__(self, texts: list[str]) -> list[tuple[float, np.ndarray]]:
        """For each text the sum of the squared marginals, and the marginal of every word."""
        if len(self.known) > CACHED:
            self.forget()
        listed = [t.split() for t in texts]
        sizes = np.array([len(ws) for ws in listed])
        if not sizes.sum():
            return [(0.0, np.zeros(0)) for _ in texts]
        if fresh := set().union(*listed).difference(self.known):
            self.learn(list(fresh))
        ids = np.fromiter((i for ws in listed for i in map(self.known.__getitem__, ws)), dtype=np.int64, count=int(sizes.sum()))
        own, before, after = self.table[:, ids]
        chains = Chains(sizes)
        inner = ~chains.opens[1:]
        emit = own + self.model.bias
        emit[1:] += np.where(inner, before[:-1], 0.0)
        emit[:-1] += np.where(inner, after[1:], 0.0)
        p = marginals(emit, chains, self.model.trans, self.model.start)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        return [(float(np.square(p[a:b]).sum()), p[a:b]) for a, b in zip(edge, edge[1:], strict=False)]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


def tag(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, score, spans array<struct<start, end, p>>: toxic words (probability over one half) by code points, end exclusive."""

    def run(batches):
        tagger = Tagger(model)
        for b in slices_of(batches, SLICE):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = tagger(texts)
            score = sigmoid(model.slope * evidence(found) + model.intercept)
            spans = []
            for text, (_, p) in zip(texts, found, strict=True):
                spans.append([{"start": m.start(), "end": m.end(), "p": float(q)} for m, q in zip(WORD.finditer(text), p, strict=True) if q > 0.5] if (p > 0.5).any() else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(score, pa.float64()), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> Field:
    model = fit(labelled_sample(docs, labels, "toxic", modulus, held_out, PER_CLASS))
    give_back()
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """The columns of query op10, and n_spans."""
    return tag(docs, learn(docs, labels, modulus, held_out)).select(
        "doc_id",
        (fold_of(modulus) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def clean_only(docs: DataFrame, model: Field, threshold: float = 0.3) -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns as they are."""
    cols = docs.columns

    def run(batches):
        tagger = Tagger(model)
        for b in slices_of(batches, SLICE):
            found = tagger([t or "" for t in b.column("text").to_pylist()])
            yield b.filter(pa.array(sigmoid(model.slope * evidence(found) + model.intercept) < threshold, pa.bool_()))

    return docs.select(*cols).mapInArrow(run, docs.schema)
