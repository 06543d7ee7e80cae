"""Calendar expressions. Weekdays are ISO (Monday = 1); no locale text
other than the English names Spark's ``EEEE`` / ``MMM`` patterns give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weekday_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def iso_weekday(d) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return (F.weekday(_c(d)) + 1).cast("int")


def week_number(d) -> Column:
    """Week of year with Monday as first day, days before the first Monday
    in week 00 (the ``%W`` convention), as a two-character string."""
    dd = _c(d)
    wk = F.floor((F.dayofyear(dd) + 6 - F.weekday(dd)) / 7)
    return F.lpad(wk.cast("string"), 2, "0")


def month_start(d) -> Column:
    return F.trunc(_c(d), "month")


def year_month(d) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def month_label(month_num) -> Column:
    """1..12 -> Jan..Dec."""
    return F.date_format(F.make_date(F.lit(2000), _c(month_num), F.lit(1)), "MMM")


def day_type(d, weekend=("Friday", "Saturday", "Sunday")) -> Column:
    iso = {"Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4,
           "Friday": 5, "Saturday": 6, "Sunday": 7}
    return F.when(iso_weekday(d).isin([iso[w] for w in weekend]), F.lit("Weekend/Friday")) \
        .otherwise(F.lit("Weekday"))
