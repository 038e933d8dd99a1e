"""Text of the portable hash and of the estimators for another SQL engine, so results can be recomputed independently."""

from __future__ import annotations

import inspect
from functools import partial
from types import ModuleType

from ..functions.hashing import BITS, PORTABLE
from ..operators.cardinality import alpha


class Portable:
    """The operators of a module over the portable hash, which SQL can recompute."""

    def __init__(self, module: ModuleType):
        self.module = module

    def __getattr__(self, name: str):
        found = getattr(self.module, name)
        return partial(found, hasher=PORTABLE) if inspect.isfunction(found) and "hasher" in inspect.signature(found).parameters else found


def h60(x: str, salt: str = "") -> str:
    text = f"'{salt}' || ({x})::varchar" if salt else f"({x})::varchar"
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def h32(x: str, part: int) -> str:
    return f"('0x' || substr(md5(({x})::varchar), {1 + 8 * part}, 8))::bigint"


def part32(x: str, i: int) -> str:
    """The i-th of the independent 32-bit hashes."""
    return f"('0x' || substr(md5('{i // 4}:' || ({x})::varchar), {1 + 8 * (i % 4)}, 8))::bigint"


def unit(x: str, salt: str = "") -> str:
    return f"(({h60(x, salt)})::double + 0.5::double) / {2**BITS}::double"


def bits(x: str) -> str:
    return f"(case when {x} > 0 then length(bin({x})) else 0 end)"


def hll_registers(table: str, item: str, keys: str, p: int, where: str = "true") -> str:
    """Registers (keys, idx, rank); keys is '' or 'a, b, '."""
    rest = BITS - p
    return f"""select {keys} h >> {rest} as idx, max({rest + 1} - {bits(f"(h & {(1 << rest) - 1})")}) as rank
      from (select {keys} {h60(item)} as h from {table} where {item} is not null and {where}) group by all"""


def hll_estimate(p: int, limit: float | None = None) -> str:
    """Estimate over registers; limit: the threshold of linear counting (HLL++), else the 2.5 m rule."""
    m = 1 << p
    zeros = f"({m}::double - count(*))"
    raw = f"({alpha(m) * m * m!r}::double / (sum(pow(2.0::double, -rank::double)) + {zeros}))"
    linear = f"({m}::double * ln({m}::double / (case when {zeros} > 0 then {zeros} else 1 end)))"
    small = f"{raw} <= {2.5 * m}::double" if limit is None else f"{linear} <= {limit}::double"
    return f"(case when {zeros} > 0 and {small} then {linear} else {raw} end)"


def theta_state(table: str, item: str, k: int, where: str = "true") -> str:
    """h and theta of the k smallest distinct hashes (no keys)."""
    return f"""select h, coalesce((select h from (select distinct {h60(item)} as h from {table} where {where}) order by h limit 1 offset {k}), {1 << BITS}) as theta
      from (select distinct {h60(item)} as h from {table} where {where}) order by h limit {k}"""


def theta_estimate(top: str = "min(theta)") -> str:
    return f"(case when coalesce({top}, {1 << BITS}) = {1 << BITS} then count(*)::double else (count(*) - 1)::double / ({top}::double / {1 << BITS}::double) end)"
