"""HR staging layer (H1-H4): trim, safe casts, derived flags.

Landing tables hold strings (ids, counts and scores typed or as text);
every conversion is a ``try_*`` so one bad value becomes NULL instead of
failing the job under ANSI mode. The as-of
date is a parameter, never the system clock.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import ratio


def _date(c: str):
    return F.try_to_date(F.col(c))


def _whole(c: str, kind: str = "int"):
    return F.col(c).try_cast(kind).alias(c)


def _id():
    return _whole("employee_id", "bigint")


def stg_employees(raw: DataFrame, as_of: str | dt.date) -> DataFrame:
    hire, term = _date("hire_date"), _date("termination_date")
    return raw.select(
        _id(), F.trim("name").alias("name"), F.trim("role").alias("role"),
        F.trim("department").alias("department"), hire.alias("hire_date"), term.alias("termination_date"),
        F.trim("termination_type").alias("termination_type"),
        F.round(F.col("hourly_rate").try_cast("decimal(18,4)"), 2).cast("double").alias("hourly_rate"),
        F.col("manager_id").try_cast("decimal(38,2)").try_cast("bigint").alias("manager_id"),
        F.trim("status").alias("status"),
        F.when(F.col("status") == "Terminated", 1).otherwise(0).cast("int").alias("is_terminated"),
        F.datediff(F.coalesce(term, F.lit(as_of).cast("date")), hire).cast("int").alias("tenure_days"),
    )


def stg_exits(raw: DataFrame) -> DataFrame:
    d = _date("exit_date")
    manager = F.col("manager_id") if "manager_id" in raw.columns else F.lit(None).cast("string")  # NULL in exports without it
    return raw.select(
        _id(), d.alias("exit_date"), F.trim("exit_reason").alias("exit_reason"),
        F.col("exit_survey_score").try_cast("int").alias("exit_survey_score"),
        F.trim("eligible_for_rehire").alias("eligible_for_rehire"),
        manager.try_cast("decimal(38,2)").try_cast("bigint").alias("manager_id"),
        F.when(F.col("exit_reason").ilike("%involuntary%"), F.lit("Involuntary")).otherwise(F.lit("Voluntary"))
        .alias("exit_category"),
        F.month(d).alias("exit_month"), F.year(d).alias("exit_year"), F.quarter(d).alias("exit_quarter"),
    )


def stg_attendance(raw: DataFrame, overtime_flag_hours: int = 15) -> DataFrame:
    m = _date("month")
    return raw.select(
        _id(), m.alias("month"), F.year(m).alias("year"), F.month(m).alias("month_num"),
        *[_whole(c) for c in ("days_worked", "days_absent", "overtime_hours", "late_arrivals")],
        ratio(_whole("days_absent"), _whole("days_worked") + _whole("days_absent"), 4).alias("absence_rate"),
        F.when(_whole("overtime_hours") >= overtime_flag_hours, 1).otherwise(0).cast("int").alias("high_overtime_flag"),
    )


def stg_reviews(raw: DataFrame) -> DataFrame:
    """Half-year labels ``YYYY-H1`` / ``YYYY-H2`` become the half's last day."""
    p = F.col("review_period")
    year4 = F.substring(p, 1, 4)
    review_date = (F.when(p.ilike("%-H1"), F.try_to_date(F.concat(year4, F.lit("-06-30"))))
                   .when(p.ilike("%-H2"), F.try_to_date(F.concat(year4, F.lit("-12-31")))))
    return raw.select(
        _id(), F.trim(p).alias("review_period"), F.col("score").try_cast("double").alias("score"),
        F.trim("manager_notes_tag").alias("manager_notes_tag"),
        F.when(F.upper("promoted") == "TRUE", 1).otherwise(0).cast("int").alias("promoted"),
        review_date.alias("review_date"), F.left(p, F.lit(4)).try_cast("int").alias("review_year"),
    )
