import hashlib
import os

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchloom.llm import prefix_hash as p

from .conftest import ODD

words = st.text(alphabet="abé😀", max_size=60)


@settings(max_examples=80, deadline=None)
@given(words, words, st.data())
def test_spans_and_extensions(x, y, data):
    a, b = p.PrefixHash(x), p.PrefixHash(y)
    i, j = data.draw(st.integers(0, len(x))), data.draw(st.integers(0, len(y)))
    assert p.common_extension(a, i, b, j) == len(os.path.commonprefix([x[i:], y[j:]]))
    n = data.draw(st.integers(0, min(len(x) - i, len(y) - j)))
    assert p.same_span(a, i, b, j, n) == (x[i : i + n] == y[j : j + n])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefgh \n", max_size=300), st.text(alphabet="abcdefgh \n", max_size=300))
def test_edited_fingerprint_equals_a_fresh_one(x, y):
    a, put = p.PrefixHash(x), y[: len(x) // 2]
    with np.errstate(over="ignore"):
        edited, mark, sketch, common = p.edited_fingerprint(x, a, put)
        want, fresh = p.fingerprint(p.PrefixHash(edited))
    assert edited == x[: len(x) - len(x) // 2] + put and mark == want and (sketch == fresh).all()
    assert common == len(os.path.commonprefix([x, edited]))


def test_polynomial_by_definition():
    text, m = "prefix", 2**31 - 1
    for k, base in enumerate(p.BASES):
        assert p.PrefixHash(text).span(0, 6)[k] == sum((ord(c) + 1) * pow(base, i, m) for i, c in enumerate(text)) % m


def test_likeness():
    f = lambda t: p.fingerprint(p.PrefixHash(t))[1]
    rnd = np.random.default_rng(1)
    t = "".join(chr(c) for c in rnd.integers(97, 123, 6000))
    other = "".join(chr(c) for c in rnd.integers(97, 123, 6000))
    assert p.likeness(f(t), f(t)) == 1 and p.likeness(f(t), f(other)) == 0
    assert 0.3 < p.likeness(f(t), f(t[:3000] + other[:3000])) < 0.7
    assert p.likeness(f(""), f("")) == 1 and p.likeness(f(""), f("x")) == 0


def test_query_against_a_loop(docs):
    rows = [(i * 7 % 101, f"text number {i} " * (i % 9)) for i in range(101)] + [(1000 + i, t) for i, (_, t) in enumerate(ODD)] + [(None, "null id")]
    got = {r["doc_id"]: r for r in p.fingerprint_digest(docs(rows).repartition(5)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (i, t), (_, u) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        t, u = t or "", u or ""
        edited, r = t[: len(t) - len(t) // 2] + u[: len(t) // 2], got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == p.fingerprint(p.PrefixHash(t))[0] and r["edited_fingerprint"] == p.fingerprint(p.PrefixHash(edited))[0]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_repeated_rows_one_row_and_none(docs):
    assert p.fingerprint_digest(docs(ODD)).count() == len(ODD)
    one = p.fingerprint_digest(docs([(5, "alone here")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"alonealone").hexdigest()
    assert p.fingerprint_digest(docs(ODD).where("false")).count() == 0


def test_fingerprints_of_a_table(docs):
    marks = {r["doc_id"]: r for r in p.fingerprints(docs(ODD)).collect()}
    assert len(marks) == len({i for i, _ in ODD}) and marks[2]["fingerprint"] == marks[3]["fingerprint"] and marks[0]["fingerprint"] == marks[1]["fingerprint"]
    a, b = p.kept_hashes(marks[5]["fingerprint"]), p.fingerprint(p.PrefixHash("long " * 30_000))[1]
    assert (a == b).all() and p.likeness(a, b) == 1
