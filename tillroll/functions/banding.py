"""Ordered bands from thresholds (a CASE chain built from a table)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tenure bands in days, upper bound exclusive, last band open.
TENURE_BANDS = [
    (90, "0-3 months"),
    (180, "3-6 months"),
    (365, "6-12 months"),
    (730, "1-2 years"),
    (1095, "2-3 years"),
    (None, "3+ years"),
]


def bucketize(x, bands) -> Column:
    """``bands`` = [(upper_exclusive, label), ..., (None, last_label)]."""
    c = F.col(x) if isinstance(x, str) else x
    expr = None
    last = None
    for upper, label in bands:
        if upper is None:
            last = label
            continue
        expr = F.when(c < upper, F.lit(label)) if expr is None else expr.when(c < upper, F.lit(label))
    return expr.otherwise(F.lit(last)) if last is not None else expr


def tenure_band(days) -> Column:
    return bucketize(days, TENURE_BANDS)


def band_labels(bands=TENURE_BANDS) -> list[str]:
    return [label for _, label in bands]
