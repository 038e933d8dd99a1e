"""The library's functions for SQL: register(spark) adds them as temporary functions of the session.

    h60(text)                               the portable hash
    hll_index(h, p), hll_rank(h, p)         slot and value of a hash
    req_agg(x), tdigest_agg(x)              binary states of a group (Arrow-batched; for very large groups build with the operators)
    req_quantile(state, q), req_rank(state, x), tdigest_quantile(state, q), tdigest_rank(state, x)
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.quantiles import Req, TDigest
from .hashing import BITS
from .spec import ReqSpec, TDigestSpec

SQL_FUNCTIONS = [
    "h60(x STRING) RETURNS BIGINT RETURN CAST(conv(substr(md5(CAST(x AS BINARY)), 1, 15), 16, 10) AS BIGINT)",
    f"hll_index(h BIGINT, p INT) RETURNS INT RETURN CAST(shiftright(h, {BITS} - p) AS INT)",
    f"""hll_rank(h BIGINT, p INT) RETURNS INT RETURN {BITS} - p + 1 - CASE WHEN (h & (shiftleft(1L, {BITS} - p) - 1)) > 0
      THEN length(bin(h & (shiftleft(1L, {BITS} - p) - 1))) ELSE 0 END""",
]


def register(spark: SparkSession) -> None:
    for text in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")

    @F.pandas_udf("binary")
    def req_agg(x: pd.Series) -> bytes:
        return Req(ReqSpec()).add(x.dropna().to_numpy(dtype=float)).to_bytes()

    @F.pandas_udf("binary")
    def tdigest_agg(x: pd.Series) -> bytes:
        return TDigest(TDigestSpec()).add(x.dropna().to_numpy(dtype=float)).to_bytes()

    def scalar(parse, method):
        @F.pandas_udf("double")
        def f(state: pd.Series, x: pd.Series) -> pd.Series:
            return pd.Series([None if s is None else getattr(parse(s), method)(v) for s, v in zip(state, x, strict=True)], dtype=float)

        return f

    spark.udf.register("req_agg", req_agg)
    spark.udf.register("tdigest_agg", tdigest_agg)
    for name, kind in (("req", Req), ("tdigest", TDigest)):
        for method in ("quantile", "rank"):
            spark.udf.register(f"{name}_{method}", scalar(kind.from_bytes, method))
