from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchloom.llm import mixing
from sketchloom.llm.mixing import OTHER, Plan, place, reorder

from .conftest import ODD


def ideal(plan, t):
    """Fluid shares at slot t by stepping from one exhaustion to the next."""
    from fractions import Fraction

    got, live, now = [Fraction(0)] * len(plan.names), set(range(len(plan.names))), Fraction(0)
    while live and now < t:
        total = sum(plan.weights[s] for s in live)
        end = min((plan.blocks[s] - got[s]) * total / plan.weights[s] for s in live)
        step = min(end, t - now)
        for s in live:
            got[s] += step * plan.weights[s] / total
        now += step
        live = {s for s in live if got[s] < plan.blocks[s]}
    return got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 50), st.integers(1, 60)), min_size=1, max_size=6), st.integers(1, 40))
def test_every_slot_is_within_one_block(sources, slice_len):
    plan = Plan(tuple(f"s{i}" for i in range(len(sources))), tuple(w for w, _ in sources), tuple(b for _, b in sources))
    short = max(slice_len, -(-sum(plan.weights) // min(plan.weights)))
    object.__setattr__(plan, "__class__", type("Short", (Plan,), {"slice_len": property(lambda self: short)}))
    rows = [r for k in range(-(-plan.total // plan.slice_len)) for r in plan.slice_rows(k)]
    assert [r[2] for r in rows] == list(range(plan.total))
    seen = Counter()
    for name, block, slot, release, deadline in rows:
        assert release <= slot < deadline and block == seen[name]
        seen[name] += 1
        for s, share in enumerate(ideal(plan, slot + 1)):
            assert abs(seen[plan.names[s]] - share) < 1
    assert seen == Counter(dict(zip(plan.names, plan.blocks, strict=True)))


def test_places_every_row_once(docs, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 5)
    rows = [(i % 90, f"text {i}") for i in range(100)] + ODD
    out = place(docs(rows), {"src0": 3, "src1": 1, OTHER: 2}, block=4).collect()
    assert len(out) == len(rows) and len({r["mix_pos"] for r in out}) == len(rows)
    blocks = defaultdict(set)
    for r in out:
        blocks[r["mix_source"], r["block"]].add(r["slot"])
        assert r["release"] <= r["slot"] < r["deadline"]
    assert all(len(s) == 1 for s in blocks.values())
    assert max(Counter((r["mix_source"], r["block"]) for r in out).values()) <= 4


def test_reorder_keeps_rows_and_columns(spark, docs, tmp_path):
    rows = [(i, f"text {i}") for i in range(60)] + ODD
    frame = docs(rows)
    weights = {"src0": 1, "src1": 1, OTHER: 1}
    out = reorder(frame, weights, block=2)
    assert out.columns == frame.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, frame.collect()))
    out.write.parquet(str(tmp_path / "o"))
    first = [r["source"] for r in spark.read.parquet(str(tmp_path / "o")).coalesce(1).collect()]
    assert len(first) == len(rows)
    assert {len(set(first[i : i + 6])) for i in range(0, 30, 6)} == {3}  # blocks of two, three sources in turn


def test_empty_and_bad_weights(docs):
    assert place(docs(ODD).where("false"), {"src0": 1}).count() == 0
    with pytest.raises(ValueError):
        place(docs(ODD), {"src0": 0})


def test_is_deterministic(docs):
    rows = [(i, f"t{i}") for i in range(50)]
    a, b = (place(docs(rows).repartition(n), {"src0": 2, OTHER: 1}, 4) for n in (1, 7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
