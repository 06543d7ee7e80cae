"""SQL text builders for the oracle twins.

They spell the same rounding recipe as ``tillroll.functions.numeric`` so
that an independent engine reproduces the digits: exact sums, ratios in
DOUBLE pinned to 8 decimals, then rounded.
"""

from __future__ import annotations


def M(x: str, k: int = 2) -> str:
    """Rounded exact value as DOUBLE."""
    return f"CAST(ROUND({x}, {k}) AS DOUBLE)"


def FIX(x: str, k: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,8)), {k}) AS DOUBLE)"


def Q(num: str, den: str, k: int, mult: float | int | None = None) -> str:
    """round((num * mult) / den, k), NULL on a zero or NULL divisor."""
    n = f"CAST({num} AS DOUBLE)"
    if mult is not None:
        n = f"({n} * CAST({float(mult)!r} AS DOUBLE))"
    return FIX(f"{n} / NULLIF(CAST({den} AS DOUBLE), 0)", k)


def ALC(col: str = "line_total") -> str:
    return f"SUM(CASE WHEN is_alcohol = 'Yes' THEN {col} ELSE 0 END)"


def FOOD(col: str = "line_total") -> str:
    return f"SUM(CASE WHEN is_alcohol = 'No' THEN {col} ELSE 0 END)"


def WEEKDAY(d: str = "date") -> str:
    return f"dayname({d})"


def ISODOW(d: str = "date") -> str:
    return f"CAST(isodow({d}) AS INTEGER)"


def YEAR(d: str = "date") -> str:
    return f"CAST(year({d}) AS INTEGER)"


def MONTH(d: str = "date") -> str:
    return f"CAST(month({d}) AS INTEGER)"
