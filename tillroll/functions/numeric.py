"""Rounding and ratio helpers.

Money is summed in DECIMAL (exact, order independent), rounded half-up, and
only then turned into DOUBLE for output. Ratios are computed in DOUBLE,
pinned to 8 decimals, then rounded: the same text gives the same digits in
Spark and in an ANSI SQL oracle, which a plain ROUND(double) does not.
Division by zero yields NULL (``try_divide``), never an ANSI error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIN = "decimal(38,8)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def money(x, scale: int = 2) -> Column:
    """Round an exact (decimal) value and expose it as DOUBLE."""
    return F.round(_c(x), scale).cast("double")


def fix(x, scale: int) -> Column:
    """Round a DOUBLE expression through a pinned decimal."""
    return F.round(_c(x).cast(_PIN), scale).cast("double")


def ratio(num, den, scale: int, mult: float | int | None = None) -> Column:
    """round((num * mult) / den, scale); NULL when den is 0 or NULL."""
    n = _c(num).cast("double")
    if mult is not None:
        n = n * F.lit(float(mult))
    return fix(F.try_divide(n, _c(den).cast("double")), scale)


def to_dec(x, scale: int = 4, precision: int = 18) -> Column:
    """Back to exact decimal for a DOUBLE that holds a short decimal."""
    return _c(x).cast(f"decimal({precision},{scale})")
