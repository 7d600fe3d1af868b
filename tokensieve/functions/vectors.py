"""Vector Column functions (arrays of doubles) and seeded uniforms.

Dot products fold left to right (``aggregate(zip_with(..))``) so the
result equals a left-to-right sum in any SQL engine bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The norm guard of an L2 normalisation, and 2^52 + 1 which
# maps 13 hex digits of an md5 to a uniform in (0, 1].
NORM_EPS = 1e-12
UNIFORM_DENOM = 4503599627370497.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x * y)
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


# V1
def l2_normalise(a, eps: float = NORM_EPS) -> Column:
    """``x / max(||x||, eps)`` element-wise.

    The sum of squares is folded once (left to right, same as ``dot(a, a)``)
    and handed to the ``finish`` lambda, so the norm is not re-evaluated for
    every element."""
    a = _c(a)
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x,
                       lambda s: F.transform(a, lambda x: x / F.greatest(F.sqrt(s), F.lit(eps))))


def scale(a, s) -> Column:
    s = _c(s) if not isinstance(s, (int, float)) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def uniform(seed, *ids) -> Column:
    """Deterministic uniform in (0, 1] from md5(seed:id...).  Never rand()."""
    key = F.concat_ws(":", F.lit(str(seed)), *[_c(i).cast("string") for i in ids])
    h = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (h + F.lit(1.0)) / F.lit(UNIFORM_DENOM)


def uniform_sql_duckdb(seed, *ids: str) -> str:
    """The DuckDB text of ``uniform`` (for oracles)."""
    key = " || ':' || ".join([f"'{seed}'"] + [f"CAST({i} AS VARCHAR)" for i in ids])
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT)::DOUBLE + 1.0) / 4503599627370497.0"


# V15
def random_projection_entry(seed, row, col, dim_out) -> Column:
    """Entry (row, col) of a seeded +-1/sqrt(d_out) projection matrix."""
    u = uniform(seed, row, col)
    sign = F.when(u < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign / F.sqrt(F.lit(float(dim_out)) if isinstance(dim_out, int) else _c(dim_out).cast("double"))
