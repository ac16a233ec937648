"""Seedable random columns for synthetic event sets.

Randomness is a pure function of a row id and a seed: the first 52 bits of
SHA-256 over ``seed:id``.  The same row always gets the same value, on any
executor and on any retry; draws with different seeds are independent; and
other SQL engines compute the same value (used by the oracle).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPAN = 2**52


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def uniform(row_id, seed: int = 0) -> Column:
    """Uniform double in [0, 1) from a row id."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), _c(row_id).cast("string")), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(_SPAN))


def uniform_sql(row_id: str, seed: int = 0) -> str:
    """The same value as ``uniform`` written as SQL text (for the oracle)."""
    return f"(('0x' || substr(sha256('{seed}:' || CAST({row_id} AS VARCHAR)), 1, 13))::BIGINT::DOUBLE / {float(_SPAN)})"


def uniform_int(row_id, lo: int, hi: int, seed: int = 0) -> Column:
    """P25: uniform int in [lo, hi] inclusive."""
    return (F.floor(uniform(row_id, seed) * (hi - lo + 1)) + lo).cast("long")


def power_law_index(row_id, n: int, a: float = 3.0, seed: int = 0) -> Column:
    """Index in [0, n) with density a*x^(a-1): weight to high ids.

    Inverse CDF of the power distribution: ``floor(u^(1/a) * n)``.
    """
    return F.floor(F.pow(uniform(row_id, seed), F.lit(1.0 / a)) * n).cast("long")


def id_string(x, length: int) -> Column:
    """Stable pseudo-random id text of ``length`` chars (hex of SHA-256;
    each further 64 chars hash the id with their number)."""
    text = _c(x).cast("string")
    parts = [F.sha2(text, 256)] + [F.sha2(F.concat(text, F.lit(f":{k}")), 256) for k in range(1, (length + 63) // 64)]
    return F.substring(F.concat(*parts) if len(parts) > 1 else parts[0], 1, length)


def filler(n: int = 500, ch: str = "a") -> Column:
    """Fixed-size payload."""
    return F.repeat(F.lit(ch), n)
