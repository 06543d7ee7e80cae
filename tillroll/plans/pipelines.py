"""Layered pipelines: RAW -> STAGING -> MARTS.

Each layer is a set of lazy DataFrames registered as views (the reference's
``CREATE OR REPLACE VIEW``); marts that several reports read are written
once as Parquet under the shared folder named by ``spark.checkpoint.dir``
(``<dir>/<run>/marts/<name>``), so the reports read files instead of
re-running the joins, and a lost executor only recomputes its own tasks.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import hr_marts, hr_reports, hr_staging, marts, quality, working
from tillroll.operators.forecast import ts_holt_winters
from tillroll.session import shared_dir
from tillroll.sources import io, schemas

# Marts with a year column are partitioned by it so date-bounded reports prune files.
RESTAURANT_PARTITIONS = {"category_monthly": ["year"], "item_performance": ["year"], "server_performance": ["year"]}


NEED_ATTENDANCE = ("mart_monthly_attrition_trend", "mart_flight_risk_signals")


def run_dir(spark: SparkSession, run_id: str | None = None) -> str:
    return shared_dir(spark, f"tillroll-run-{run_id or uuid.uuid4().hex[:12]}")


def build_restaurant_marts(spark: SparkSession, sales: DataFrame, out: str) -> dict[str, str]:
    """Write the five restaurant marts; returns name -> path. One scan of
    the sales: the cube of all marts is written once, split by mart, and
    each mart is published from its part."""
    at = f"{out}/cube"
    io.write_mart(marts.mart_cube(sales), at, ["mart"])
    cube = spark.read.parquet(at)
    paths = {}
    for name in marts.MARTS:
        paths[name] = io.publish_mart(marts.mart_of(cube, name), f"{out}/marts/{name}", RESTAURANT_PARTITIONS.get(name))
        io.register_view(io.read_mart(spark, paths[name]), name)
    return paths


def build_working(spark: SparkSession, sales: DataFrame, out: str, category: str = "Dolci") -> dict[str, DataFrame]:
    """Order-grain and item-grain working tables of the sales, written once
    by one scan; returns them and ``both``."""
    at = io.publish_mart(working.working_tables(sales, category), f"{out}/marts/sales_working", ["grain"])
    both = spark.read.parquet(at)
    return {"both": both, "orders": working.orders_of(both), "items": working.items_of(both)}


def read_marts(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    return {name: io.read_mart(spark, p) for name, p in paths.items()}


def hr_staging_layer(raw: dict[str, DataFrame], as_of: str | dt.date) -> dict[str, DataFrame]:
    """raw keys: employees, exit_records, attendance_monthly (None: no such
    export, staged without rows), performance_reviews."""
    if raw["attendance_monthly"] is None:
        raw = raw | {"attendance_monthly": raw["employees"].sparkSession.createDataFrame([], schemas.RAW_ATTENDANCE_MONTHLY)}
    stg = {
        "stg_employees": hr_staging.stg_employees(raw["employees"], as_of),
        "stg_exit_records": hr_staging.stg_exits(raw["exit_records"]),
        "stg_attendance_monthly": hr_staging.stg_attendance(raw["attendance_monthly"]),
        "stg_performance_reviews": hr_staging.stg_reviews(raw["performance_reviews"]),
    }
    for name, df in stg.items():
        io.register_view(df, name)
    return stg


def bucketed_staging(spark: SparkSession, stg: dict[str, DataFrame], buckets: int,
                     namespace: str = "staging") -> dict[str, DataFrame]:
    """Write the staging layer as tables bucketed by employee_id (same
    bucket count for all), so the mart joins and per-employee aggregates
    (attendance averages, latest review) run without shuffles."""
    io.create_namespaces(spark, [namespace])
    return {name: io.write_bucketed(df, f"{namespace}.{name}", ["employee_id"], buckets) for name, df in stg.items()}


def build_hr_marts(spark: SparkSession, raw: dict[str, DataFrame], as_of: str | dt.date, out: str,
                   bucket_staging: int | None = None) -> dict[str, str]:
    """Write the four HR marts the notebook reads; returns name -> path.
    ``bucket_staging=N`` first writes the staging layer bucketed by
    employee_id into N buckets."""
    s = hr_staging_layer(raw, as_of)
    if bucket_staging:
        s = bucketed_staging(spark, s, bucket_staging)
    emp, ex, att, rv = (s["stg_employees"], s["stg_exit_records"], s["stg_attendance_monthly"],
                        s["stg_performance_reviews"])
    built = {
        "mart_employee_attrition": hr_marts.hr_employee_attrition(emp, ex, rv, att),
        "mart_monthly_attrition_trend": hr_marts.hr_monthly_trend(att, ex),
        "mart_manager_scorecard": hr_marts.hr_manager_scorecard(emp, ex, att),
        "mart_flight_risk_signals": hr_marts.hr_flight_risk(emp, rv, att, as_of),
    }
    if raw["attendance_monthly"] is None:  # inner-joined to attendance: would be empty
        built = {k: v for k, v in built.items() if k not in NEED_ATTENDANCE}
    paths = {}
    for name, df in built.items():
        paths[name] = io.publish_mart(df, f"{out}/marts/{name}")
        io.register_view(io.read_mart(spark, paths[name]), name)  # reports and users read marts by name
    return paths


def hr_reports_from_marts(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The notebook's report tables over the written marts (lazy)."""
    m = read_marts(spark, {k: v for k, v in paths.items() if k.startswith("mart_")})
    att, sc = m["mart_employee_attrition"], m["mart_manager_scorecard"]
    out = {
        "hr_headline_kpis": hr_reports.hr_headline_kpis(att),
        "hr_rate_by_role": hr_reports.hr_rate_by_role(att),
        "hr_rate_by_tenure": hr_reports.hr_rate_by_tenure(att),
        "hr_exit_reasons": hr_reports.hr_exit_reasons(att),
        "hr_reason_by_role": hr_reports.hr_reason_by_role(att, hr_reports.exit_reasons(att)),
        "hr_worst_managers": hr_reports.hr_worst_managers(sc),
        "hr_ot_burnout": hr_reports.hr_ot_burnout(sc),
        "hr_ot_burnout_corr": hr_reports.hr_ot_burnout_corr(sc),
        "dq_category_mismatch": quality.dq_category_mismatch(
            att.filter("exit_category IS NOT NULL"), "termination_type", "exit_category"),
    }
    if "mart_monthly_attrition_trend" in m:
        trend = m["mart_monthly_attrition_trend"]
        out |= {
            "hr_rolling_rate": hr_reports.hr_rolling_rate(trend),
            "hr_seasonality": hr_reports.hr_seasonality(trend),
            "hr_season_spikes": hr_reports.hr_season_spikes(trend),
            "ts_holt_winters": ts_holt_winters(trend.withColumn("series_id", F.lit("attrition_rate")), "series_id", "period_month",
                                               "monthly_attrition_rate", 12, 6, fill="interpolate"),
        }
    if "mart_flight_risk_signals" in m:
        risk = m["mart_flight_risk_signals"]
        out |= {
            "hr_risk_levels": hr_reports.hr_risk_levels(risk),
            "hr_risk_distribution": hr_reports.hr_risk_distribution(risk),
            "hr_top_risk": hr_reports.hr_top_risk(risk),
            "hr_key_findings": hr_reports.hr_key_findings(att, sc, risk),
        }
    return out
