"""Retail rules, the forecast recurrence, and the source/sink helpers."""

import datetime as dt
import os
import tempfile
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import forecast, retail
from tillroll.sources import io, schemas


def test_stock_status_edges(spark):
    inv = spark.createDataFrame([("S1", "c", "p1", 20, 20, D("1")), ("S1", "c", "p2", 150, 20, D("1")),
                                 ("S1", "c", "p3", 151, 20, D("1")), ("S1", "c", "p4", 21, 20, D("2"))],
                                "store_id string, category string, product string, units_in_stock int, reorder_threshold int, unit_cost decimal(18,2)")
    got = {r.product: r.status for r in retail.retail_stock_status(inv).collect()}
    assert got == {"p1": "Low Stock", "p2": "OK", "p3": "Overstocked", "p4": "OK"}
    val = {(r.status, r.category): r.stock_value for r in retail.retail_stock_value(inv).collect()}
    assert val[("OK", "c")] == 150 + 42


def test_expense_check_flags_mismatch(spark):
    ex = spark.createDataFrame([("S1", 2024, 1, 10, 20, 3, 4, 37), ("S1", 2024, 2, 10, 20, 3, 4, 36)],
                               "store_id string, year int, month int, rent long, labor long, utilities long, misc_expenses long, total_expenses long")
    assert [r.mismatch for r in retail.retail_expense_check(ex).collect()] == [False, True]


def test_filters_reach_parquet_scan(spark):
    tmp = tempfile.mkdtemp(prefix="tillroll-test-")
    df = spark.createDataFrame([("S001", dt.date(2024, 1, 5), "c", 1, 2, D("10"), D("4"))],
                               "store_id string, date date, category string, product int, units int, revenue decimal(18,2), cost decimal(18,4)")
    df.write.parquet(tmp + "/s")
    q = retail.retail_kpis(spark.read.parquet(tmp + "/s"), ["S001", "S002"], "2024-01-01", "2024-12-31")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(store_id" in plan and "GreaterThanOrEqual(date" in plan
    assert q.collect()[0].gross_profit == 6.0


def _loop_hw(y, m, a, b, g):
    level = y[:m].mean()
    trend = (y[m:2 * m].mean() - y[:m].mean()) / m
    season = list(y[:m] - level)
    sse = 0.0
    for t, yt in enumerate(y):
        s = season[t % m]
        sse += (yt - (level + trend + s)) ** 2
        nl = a * (yt - s) + (1 - a) * (level + trend)
        nb = b * (nl - level) + (1 - b) * trend
        season[t % m] = g * (yt - level - trend) + (1 - g) * s
        level, trend = nl, nb
    return sse, level, trend, season


def test_holt_winters_matches_scalar_loop(spark):
    rng = np.random.default_rng(1)
    t = np.arange(48)
    y = 10 + 0.3 * t + 3 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 0.2, 48)
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(48)]
    df = spark.createDataFrame([("s", m, float(v)) for m, v in zip(months, y)], "sid string, m date, v double")
    out = forecast.ts_holt_winters(df, "sid", "m", "v", 12, 6).collect()
    a, b, g = out[0].alpha, out[0].beta, out[0].gamma
    sse, level, trend, season = _loop_hw(y, 12, a, b, g)
    assert abs(out[0].rmse - (sse / 48) ** 0.5) < 1e-5
    ahead = [r.value for r in out if r.kind == "forecast"]
    assert np.allclose(ahead, [level + k * trend + season[(48 + k - 1) % 12] for k in range(1, 7)], atol=1e-5)
    coarse = min(_loop_hw(y, 12, i, j, k)[0] for i in forecast.GRID for j in forecast.GRID for k in forecast.GRID)
    assert sse <= coarse + 1e-9  # the refinement never ends above the grid


def test_forecast_operator_rows_and_short_series(spark):
    months = [dt.date(2020 + i // 12, i % 12 + 1, 1) for i in range(36)]
    rows = [("long", m, 5.0 + (i % 12)) for i, m in enumerate(months) if i != 7] + [("short", m, 1.0 + i) for i, m in enumerate(months[:6])]
    df = spark.createDataFrame(rows, "sid string, m date, v double")
    out = forecast.ts_holt_winters(df, "sid", "m", "v", 12, 6).collect()
    kinds = {}
    for r in out:
        kinds.setdefault((r.series_id, r.kind), []).append(r)
    assert len(kinds[("long", "actual")]) == 36  # the gap month is filled
    assert len(kinds[("long", "forecast")]) == 6 and kinds[("long", "forecast")][0].period_month > months[-1]
    assert [r.value for r in kinds[("short", "actual")]] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]  # kept
    assert len(kinds[("short", "insufficient_history")]) == 1


def test_gap_months_of_rates_and_sums(spark):
    rows = [("r", dt.date(2024, 1, 1), 0.05), ("r", dt.date(2024, 4, 1), 0.08), ("r", dt.date(2024, 5, 1), None)]
    df = spark.createDataFrame(rows, "sid string, m date, v double")
    got = lambda fill: [round(r.value, 6) for r in forecast.monthly_series(df, "sid", "m", "v", fill).orderBy("period_month").collect()]
    assert got("interpolate") == [0.05, 0.06, 0.07, 0.08, 0.08]
    assert got("zero") == [0.05, 0.0, 0.0, 0.08, 0.0]
    with pytest.raises(Exception, match="no value for"):
        got("error")
    with pytest.raises(ValueError):
        forecast.monthly_series(df, "sid", "m", "v", "guess")


def test_csv_landing_and_mart_roundtrip(spark):
    tmp = tempfile.mkdtemp(prefix="tillroll-test-")
    p = os.path.join(tmp, "exits.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("employee_id,exit_date,exit_reason,exit_survey_score,eligible_for_rehire,manager_id\r\n")
        f.write("1,2024-01-02,Burnout,3,Yes,140.0\r\n2,oops,Better Pay,notanint,No,\r\n")
    df = io.read_csv(spark, p, schemas.RAW_EXIT_RECORDS)
    rows = {r.employee_id: r for r in df.collect()}
    assert rows[1].manager_id == "140.0" and rows[1]._corrupt_record is None
    assert rows[2].exit_survey_score is None and rows[2]._corrupt_record is not None
    assert io.landing_counts(df).collect()[0].corrupt_rows == 1
    assert [r.employee_id for r in io.corrupt_rows(df).collect()] == [2]
    out = os.path.join(tmp, "mart")
    io.write_mart(df.drop("_corrupt_record").withColumn("year", F.lit(2024)), out, ["year"])
    back = io.read_mart(spark, out)
    assert back.count() == 2 and all(c == c.lower() for c in back.columns)
    assert io.lower_columns(spark.createDataFrame([(1,)], "A int")).columns == ["a"]


def test_typed_table_ddl_and_append(spark):
    tmp = tempfile.mkdtemp(prefix="tillroll-test-")
    io.create_namespaces(spark, ["raw"])
    t = io.create_table(spark, "raw.staff_dim", schemas.STAFF_DIM, os.path.join(tmp, "staff"))
    assert t.schema == schemas.STAFF_DIM
    rows = spark.createDataFrame([("E1", "Ann", "Server", D("12.50"), dt.date(2020, 1, 1))], schemas.STAFF_DIM)
    io.bulk_load(rows, os.path.join(tmp, "staff"))
    spark.catalog.refreshTable("raw.staff_dim")
    assert spark.table("raw.staff_dim").collect()[0].name == "Ann"


def test_retail_operators_equal_on_daily_mart(spark):
    from tillroll.sources.testdata import TestTables
    from tests.conftest import SF_SMALL
    sales = TestTables(spark, SF_SMALL).store_sales()
    mart = retail.retail_daily_mart(sales)
    for fn in (retail.retail_kpis, retail.retail_by_store, retail.retail_by_category, retail.retail_gross_profit,
               retail.retail_monthly, retail.retail_category_rank, retail.retail_yoy, retail.retail_seasonality):
        a = sorted(tuple(r) for r in fn(sales).collect())
        b = sorted(tuple(r) for r in fn(mart).collect())
        assert a == b, fn.__name__
    f = dict(stores=["S001", "S002"], date_from="1996-01-01", date_to="1997-12-31")
    assert retail.retail_kpis(sales, **f).collect() == retail.retail_kpis(mart, **f).collect()
