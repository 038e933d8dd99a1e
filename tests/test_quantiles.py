import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.functions.spec import KllSpec, ReqSpec, TDigestSpec
from sketchloom.operators import quantiles as q
from sketchloom.sources.codec import CodecError, pack, unpack


def rank_error(x, value, rank):
    return min(abs((x < value).mean() - rank), abs((x <= value).mean() - rank)) if not (x < value).mean() <= rank <= (x <= value).mean() else 0


@pytest.mark.parametrize("mode", ["HRA", "LRA"])
def test_req_is_sharp_at_its_end(mode):
    x = np.random.default_rng(1).permutation(100_000).astype(float)
    parts = [q.Req(ReqSpec(12, mode)).add(p) for p in np.array_split(x, 37)]
    total = parts[0]
    for p in parts[1:]:
        total.merge(q.Req.from_bytes(p.to_bytes()))
    assert total.n == len(x) and total.min == 0 and total.max == 99_999 and total.retained < 20_000
    sharp = [0.99, 0.999, 0.9999] if mode == "HRA" else [0.01, 0.001, 0.0001]
    for r in sharp:
        assert rank_error(x, total.quantile(r), r) <= 0.06 * min(r, 1 - r) + 1e-5
    assert rank_error(x, total.quantile(0.5), 0.5) < 0.05
    assert total.cdf([-1.0, 1e9]) == [0.0, 1.0, 1.0]
    with pytest.raises(ValueError):
        total.merge(q.Req(ReqSpec(13, mode)))


def test_tdigest():
    x = np.random.default_rng(2).lognormal(size=50_000)
    total = q.TDigest(TDigestSpec(100))
    for p in np.array_split(x, 20):
        total.merge(q.TDigest.from_bytes(q.TDigest(TDigestSpec(100)).add(p).to_bytes()))
    for r in (0.01, 0.25, 0.5, 0.9, 0.99, 0.999):
        assert rank_error(x, total.quantile(r), r) < 0.01
        assert abs(total.rank(total.quantile(r)) - r) < 0.01
    assert total.quantile(0) == x.min() and total.quantile(1) == x.max() and total.rank(x.max()) == 1.0
    assert abs(total.trimmed_mean(0.1, 0.9) - np.sort(x)[5000:45000].mean()) < 0.02
    assert total.trimmed_mean(0.9, 0.1) is None and len(total.means) < 400
    empty = q.TDigest()
    assert empty.quantile(0.5) is None and empty.rank(1.0) is None


def test_states_by_key_with_nulls(spark):
    df = spark.range(10_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 10 > 0, F.col("id").cast("double")).alias("x")).repartition(9)
    for build, parse in ((q.req_build, q.Req.from_bytes), (q.tdigest_build, q.TDigest.from_bytes)):
        state = build(df, "x", ["g"])
        got = {r["g"]: r for r in q.ask(state, ["g"], parse, {"m": lambda s: s.quantile(0.5), "n": lambda s: float(s.n)}).collect()}
        assert got[0]["n"] == 4000 and got[1]["n"] == 5000 and abs(got[1]["m"] - 5000) < 250
        assert build(df.where("false"), "x", []).count() == 0


def test_kll(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("x"))
    state = q.kll_build(df, "x", [])
    row = q.kll_quantiles(state, [0.0, 0.25, 0.5, 0.75, 1.0], []).first()
    assert row["q0"] == 0 and row["q4"] == 99_999
    for r in (0.25, 0.5, 0.75):
        assert abs(row[f"q{int(r * 4)}"] / 100_000 - r) < 0.02
    with pytest.raises(ValueError):
        q.kll_quantiles(state, [1.5], [])
    with pytest.raises(ValueError):
        KllSpec(7)


@pytest.mark.parametrize("data", [b"garbage", b"", b"SLM1" + b"\x09" * 6, pack("kll", b"x"), pack("req", b"x")[:-1], pack("req", b"x") + b"y"])
def test_garbage_is_refused(data):
    with pytest.raises(CodecError):
        unpack("req", data)
