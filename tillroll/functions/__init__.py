"""Shared column expressions and window patterns (all JVM-side built-ins)."""

from tillroll.functions.numeric import fix, money, ratio, to_dec  # noqa: F401
from tillroll.functions.calendar import (  # noqa: F401
    day_type, iso_weekday, month_label, month_start, week_number, weekday_name, year_month,
)
from tillroll.functions.banding import bucketize, tenure_band  # noqa: F401
