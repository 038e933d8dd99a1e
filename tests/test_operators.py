"""Properties of the summaries: merges do not depend on order or partitioning, edge cases, bounds against exact answers."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sketchloom.functions.hashing import FAST, MURMUR3, PORTABLE, Hasher
from sketchloom.functions.spec import AodSpec, BloomSpec, CpcSpec, FrequentSpec, HllSpec, LinearSpec, MatrixSpec, SampleSpec, ThetaSpec
from sketchloom.operators import cardinality as c
from sketchloom.operators import frequency as f
from sketchloom.operators import membership as b
from sketchloom.operators import sampling as s
from sketchloom.operators import theta as t


def strings(spark, n, first=0):
    return spark.range(first, first + n).select(F.col("id").cast("string").alias("v"))


def same(x, y):
    cols = sorted(x.columns)
    return sorted(map(tuple, x.select(cols).collect())) == sorted(map(tuple, y.select(cols).collect()))


@pytest.mark.parametrize("hasher", [PORTABLE, FAST, MURMUR3])
def test_distinct_counts_are_near(spark, hasher):
    df = strings(spark, 50_000)
    hll = c.hll_estimate(c.hll_build(df, "v", [], hasher=hasher), []).first()[0]
    cpc = c.cpc_estimate(c.cpc_build(df, "v", [], hasher=hasher), []).first()["estimate"]
    wide = c.cpc_estimate(c.cpc_build(df, "v", [], CpcSpec(12), hasher), [], CpcSpec(12)).first()["estimate"]
    theta = t.theta_estimate(t.theta_build(df, "v", [], hasher=hasher), []).first()["estimate"]
    for x in (hll, cpc, wide, theta):
        assert abs(x - 50_000) < 0.06 * 50_000


def test_polynomial_agrees_with_definition():
    for n in (100, 3000, 9000):
        assert c.icon_inverse(n, 11) > n * 0.99
    expected = 2048 * sum(1 - (1 - 2.0 ** -(k + 1) / 2048) ** 20000 for k in range(60))
    assert abs(c.icon_inverse(expected, 11) - 20000) < 1


def test_merge_laws(spark):
    x, y = strings(spark, 3000), strings(spark, 3000, 1500)
    for build, merge in (
        (lambda d: c.hll_build(d, "v", []), lambda p, q: c.hll_merge(p, q, [])),
        (lambda d: c.linear_build(d, "v", [], LinearSpec(4096)), c.linear_merge),
        (lambda d: b.bloom_build(d, "v", [], BloomSpec(5000)), b.bloom_merge),
        (lambda d: t.theta_build(d, "v", [], ThetaSpec(256)), lambda p, q: t.theta_union(p, q, [], ThetaSpec(256))),
    ):
        p, q, whole = build(x), build(y), build(x.union(y))
        assert same(merge(p, q), merge(q, p))
        assert same(merge(p, p), p)
        assert same(merge(p, q), whole)


def test_partitioning_does_not_matter(spark):
    x = strings(spark, 5000)
    for n in (1, 7):
        assert same(c.hll_build(x.repartition(n), "v", []), c.hll_build(x, "v", []))
        assert same(f.matrix_build(x.repartition(n), "v", [], MatrixSpec(64, 3)), f.matrix_build(x, "v", [], MatrixSpec(64, 3)))
        assert same(s.uniform_sample(x.repartition(n), "v", SampleSpec(50)), s.uniform_sample(x, "v", SampleSpec(50)))


def test_screening_changes_nothing(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("v"))
    assert same(t.theta_build(rows, "v", ["g"], ThetaSpec(128)), t.theta_build(rows, "v", ["g"], ThetaSpec(128), screen=False))
    assert same(t.theta_build(rows, "v", [], ThetaSpec(128)), t.theta_build(rows, "v", [], ThetaSpec(128), screen=False))


def test_many_keys_are_not_shuffled_for_the_screen(spark, monkeypatch):
    """With more keys than bounds the result is the same, and no raw row is joined by a shuffle."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 5000).alias("g"), F.col("id").cast("string").alias("v"))
    want = t.theta_build(rows, "v", ["g"], ThetaSpec(64), screen=False)
    monkeypatch.setattr(t, "MOST_KEYS", 1)
    screened = t.theta_build(rows, "v", ["g"], ThetaSpec(64))
    assert same(screened, want)
    plan = screened._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    monkeypatch.setattr(s, "MOST_GROUPS", 1)
    few = s.uniform_sample_by(rows, ["g"], "v", SampleSpec(5))
    assert few.groupBy("g").count().where("count > 5").count() == 0 and few.where("g = 0").count() == 5
    assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("a",), ("a",), (None,)], "v string")
    empty = df.where("false")
    assert c.hll_build(df, "v", []).count() == 1
    assert t.theta_estimate(t.theta_build(df, "v", []), []).first()["estimate"] == 1
    assert c.hll_build(empty, "v", []).count() == 0 and c.cpc_build(empty, "v", []).count() == 0
    assert c.hll_estimate(c.hll_build(empty, "v", []), []).first()[0] == 0.0
    assert b.bloom_contains(b.bloom_build(empty, "v", [], BloomSpec(10)), df, "v", BloomSpec(10)).collect() == [("a", False)]
    assert s.uniform_sample(df, "v", SampleSpec(5)).count() == 2
    assert f.frequent_build(empty, "v", FrequentSpec(4)).count() == 0


def test_small_counts_are_exact(spark):
    df = strings(spark, 300)
    assert t.theta_estimate(t.theta_build(df, "v", []), []).first()["estimate"] == 300
    assert abs(c.hll_estimate(c.hll_build(df, "v", []), []).first()[0] - 300) < 12


def test_set_operations(spark):
    a, d = (t.theta_build(x, "v", [], ThetaSpec(1024)) for x in (strings(spark, 20_000), strings(spark, 20_000, 10_000)))
    size = lambda x: t.theta_estimate(x, []).first()["estimate"]
    assert abs(size(t.theta_union(a, d, [], ThetaSpec(1024))) - 30_000) < 3000
    assert abs(size(t.theta_intersect(a, d, [])) - 10_000) < 2000
    assert abs(size(t.theta_difference(a, d, [])) - 10_000) < 2000


def test_tuple_totals_and_aod(spark):
    rows = spark.range(2000).select((F.col("id") % 500).alias("k"), F.lit(1.0).alias("x"), F.col("id").alias("at"))
    state = t.tuple_build(rows, "k", {"x": ("sum", "x")}, [])
    assert t.tuple_estimate(state, [], ["x"]).first()["total_x"] == 2000
    aod = t.aod_build(rows, "k", ["at"], "at", [], AodSpec(4096, 1))
    assert aod.agg(F.min(F.col("values")[0])).first()[0] == 1500  # the last write of each key
    with pytest.raises(ValueError):
        t.aod_build(rows, "k", ["at"], "at", [], AodSpec(10, 2))


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    spec = BloomSpec(2000, 0.01)
    state = b.bloom_build(strings(spark, 2000), "v", [], spec)
    asked = b.bloom_contains(state, strings(spark, 10_000), "v", spec)
    hits = asked.where("hit")
    assert hits.where("cast(v as int) < 2000").count() == 2000
    assert hits.count() - 2000 < 8000 * 0.02
    joined = b.bloom_semi_join(strings(spark, 10_000), "v", state, spec)
    assert same(joined, hits.select("v"))


def test_counting_bloom_removes_members_only(spark):
    spec = BloomSpec(1000, 0.001)
    state = b.counting_build(strings(spark, 100), "v", [], spec)
    left = b.counting_remove(state, strings(spark, 50).union(strings(spark, 10, 5000)), "v", spec)
    hits = {r["v"] for r in b.counting_contains(left, strings(spark, 100), "v", spec).where("hit").collect()}
    assert hits == {str(i) for i in range(50, 100)}


def test_counting_bloom_removed_is_exact_in_an_overfull_filter(spark):
    spec = BloomSpec(20, 0.1)
    members, asked = strings(spark, 200), strings(spark, 100, 150).union(strings(spark, 1, 150)).union(spark.createDataFrame([(None,)], "v string"))
    state = b.counting_build(members, "v", [], spec)
    assert b.counting_contains(state, asked, "v", spec).where("hit and cast(v as int) >= 200").count() > 0
    found = sorted(map(tuple, b.counting_removed(state, members.unionByName(members), asked, "v", spec).collect()))
    assert found == [(str(i), i < 200) for i in range(150, 250)]
    assert not b.counting_removed(state.where("false"), members.where("false"), asked, "v", spec).where("removed").count()


def test_count_sketch_merges(spark):
    spec = MatrixSpec(256, 5)
    x = strings(spark, 500).union(strings(spark, 5)).union(strings(spark, 5))
    halves = [f.matrix_build(x.where(w), "v", [], spec, signed=True) for w in ("cast(v as int) % 2 = 0", "cast(v as int) % 2 = 1")]
    assert same(f.matrix_merge(*halves, []).where("n <> 0"), f.matrix_build(x, "v", [], spec, signed=True).where("n <> 0"))


def test_misra_gries_bounds(spark):
    items = [f"item_{i % 30}" for i in range(200)] + ["hot"] * 500
    df = spark.createDataFrame([(i,) for i in items], "v string").repartition(20)
    rows = {r["item"]: r for r in f.frequent_items(f.frequent_build(df, "v", FrequentSpec(5)), threshold=0).collect()}
    assert rows["hot"]["lower"] <= 500 <= rows["hot"]["upper"]
    for k, r in rows.items():
        assert r["lower"] <= items.count(k) <= r["upper"]
    assert f.top_k(f.frequent_build(df, "v", FrequentSpec(5)), 1).first()["item"] == "hot"


def test_many_summaries_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(f, "FAN_IN", 2)
    items = [f"item_{i % 40}" for i in range(400)] + ["hot"] * 300
    df = spark.createDataFrame([(i,) for i in items], "v string")
    rows = f.frequent_build(df, "v", FrequentSpec(6)).collect()
    hot = next(r for r in rows if r["item"] == "hot")
    assert len(rows) <= 6 and hot["n"] <= 300 <= hot["n"] + hot["offset"] and hot["total"] == 700


def test_icon_of_many_sizes():
    import numpy as np

    for lg_k in (4, 8, 12, 20):
        k = 1 << lg_k
        n = np.array([2.0, k / 3, k, 3.0 * k, 20.0 * k, 1000.0 * k])
        p = 2.0 ** -(np.arange(64) + 1.0) / k
        coupons = -(k * np.expm1(n[:, None] * np.log1p(-p))).sum(axis=1)
        found = c.icon_inverse(coupons, lg_k)
        assert np.allclose(found[coupons >= 2], n[coupons >= 2], rtol=1e-6)
    assert c.icon_inverse(0.0, 9) == 0 and c.icon_inverse(1.0, 9) == 1


def test_bytes_are_canonical_and_checked(spark):
    from sketchloom.sources.codec import from_bytes, to_bytes

    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("v"))
    state = c.hll_build(df, "v", ["g"])
    one, two = (to_bytes(x, ["g"], "hll", {"p": 12}).orderBy("g").collect() for x in (state, state.repartition(7)))
    assert one == two and all(r["memory_usage"] == len(r["state"]) for r in one)
    blob = to_bytes(state, ["g"], "hll", {"p": 12})
    assert same(from_bytes(blob, ["g"], "hll", {"p": 12}), state)
    for family, parameters in (("cpc", {"p": 12}), ("hll", {"p": 11})):
        with pytest.raises(Exception, match="CodecError"):
            from_bytes(blob, ["g"], family, parameters).collect()
    junk = spark.createDataFrame([(1, bytearray(b"garbage"))], "g long, state binary")
    with pytest.raises(Exception, match="CodecError"):
        from_bytes(junk, ["g"], "hll", {"p": 12}).collect()
    assert from_bytes(spark.createDataFrame([(1, None)], "g long, state binary"), ["g"], "hll", {"p": 12}).count() == 0


def test_conservative_update_never_under():
    assert f.conservative_update([0, 3], 5) == [5, 5]


def test_varopt_is_unbiased(spark):
    rows = spark.range(200).select("id", (F.col("id") + 1).cast("double").alias("w")).cache()
    true, ests = sum(range(1, 101)), []
    for seed in range(12):
        sample = s.varopt_sample(rows, "id", "w", SampleSpec(40), seed)
        ests.append(s.subset_sum(sample, "w", F.col("id") < 100).first()["estimate"])
        assert sample.count() == 40
    assert abs(sum(ests) / len(ests) - true) < 0.15 * true
    few = s.varopt_sample(rows.limit(10), "id", "w", SampleSpec(40))
    assert few.count() == 10 and few.where("w <> adjusted").count() == 0


def test_weighted_sample_prefers_weight(spark):
    rows = spark.createDataFrame([("heavy", 1000.0), ("medium", 10.0), ("light", 1.0), ("none", 0.0)], "k string, w double")
    wins = [s.weighted_sample(rows, "k", "w", SampleSpec(1), seed).first()["k"] for seed in range(10)]
    assert wins.count("heavy") >= 8
    assert s.weighted_sample(rows, "k", "w", SampleSpec(9)).count() == 3


@settings(max_examples=30, deadline=None)
@given(st.integers(4, 20), st.integers(4, 20), st.integers(0, 2**60 - 1))
def test_folding_rule(p, q, h):
    """Index and rank at the smaller p follow from those at the larger."""
    p, q = max(p, q), min(p, q)

    def coupon(bits):
        low = h & ((1 << (60 - bits)) - 1)
        return h >> (60 - bits), 60 - bits - low.bit_length() + 1

    (i, r), cut = coupon(p), p - q
    head = i & ((1 << cut) - 1)
    assert coupon(q) == (i >> cut, cut - head.bit_length() + 1 if head else cut + r)


def test_bit_length(spark):
    from sketchloom.functions.hashing import bit_length

    values = [0, 1, 2, 3, *[(1 << n) + d for n in range(2, 61) for d in (-2, -1, 0, 1, 2)]]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", bit_length(F.col("v")).alias("n")).collect()
    assert all(r["n"] == r["v"].bit_length() for r in rows)


def test_hasher_kinds():
    with pytest.raises(ValueError):
        Hasher("other")


@pytest.mark.parametrize(
    "make",
    [
        lambda: HllSpec(3), lambda: HllSpec(30), lambda: HllSpec("a"), lambda: CpcSpec(3), lambda: CpcSpec(27), lambda: ThetaSpec(0), lambda: LinearSpec(0), lambda: LinearSpec.for_cardinality(0, 0.1),
        lambda: BloomSpec(0), lambda: BloomSpec(10, 0.0), lambda: BloomSpec(10, 1.0), lambda: BloomSpec(10, 0.1, 0), lambda: MatrixSpec(0, 1), lambda: MatrixSpec(1, 0), lambda: MatrixSpec.for_error(0, 0.1),
        lambda: MatrixSpec.for_error(0.1, 1.0), lambda: FrequentSpec(0), lambda: FrequentSpec.for_error(0.0), lambda: AodSpec(0), lambda: AodSpec(1, 0), lambda: SampleSpec(0), lambda: SampleSpec(-1),
    ],
)
def test_invalid_parameters(make):
    with pytest.raises(ValueError):
        make()
