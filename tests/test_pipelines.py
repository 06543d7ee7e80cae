"""Layered pipelines: marts written once, reports over the written marts
equal the reports over the lazy plan."""

from tillroll.operators import marts
from tillroll.plans import hr_queries, pipelines
from tillroll.plans.hr_queries import q_hr_employee_attrition
from tillroll.sources.testdata import AS_OF, TestTables
from tests.conftest import SF_SMALL


def _same(a, b):
    key = sorted(a.columns)
    ra = sorted(tuple(str(r[c]) for c in key) for r in a.collect())
    rb = sorted(tuple(str(r[c]) for c in key) for r in b.collect())
    return ra == rb


def test_restaurant_marts_roundtrip_and_reconcile(spark):
    t = TestTables(spark, SF_SMALL)
    out = pipelines.run_dir(spark)
    paths = pipelines.build_restaurant_marts(spark, t.sales(), out)
    written = pipelines.read_marts(spark, paths)
    assert _same(written["hourly_heatmap"], marts.mart_hourly_heatmap(t.sales()))
    rec = marts.dq_mart_reconcile(t.sales(), written).collect()
    assert len(rec) == 5 and all(r.reconciled for r in rec)


def test_hr_reports_over_written_marts(spark):
    t = TestTables(spark, SF_SMALL)
    raw = {"employees": t.employees_raw(), "exit_records": t.exits_raw(),
           "attendance_monthly": t.attendance_raw(), "performance_reviews": t.reviews_raw()}
    paths = pipelines.build_hr_marts(spark, raw, AS_OF, pipelines.run_dir(spark))
    reps = pipelines.hr_reports_from_marts(spark, paths)
    assert spark.catalog.tableExists("stg_employees")
    for name in ("hr_headline_kpis", "hr_rate_by_tenure", "hr_risk_distribution", "hr_key_findings"):
        assert _same(reps[name], hr_queries.__dict__[f"q_{name}"](spark, SF_SMALL)), name


def test_restaurant_runner_from_landed_tables(spark):
    """Tables landed as Parquet -> marts + every analysis written; results
    equal the lazy queries."""
    import tempfile

    from tillroll.plans import restaurant_queries, run
    from tillroll.sources import io
    t = TestTables(spark, SF_SMALL)
    land = tempfile.mkdtemp(prefix="tillroll-land-")
    frames = {"sales": t.sales(), "reservations": t.reservations(), "purchases": t.purchases(), "labor": t.labor(),
              "guests": t.guests(), "menu": t.menu_dim(), "staff": t.staff_dim()}
    paths = {}
    for k, df in frames.items():
        paths[k] = f"{land}/{k}"
        io.bulk_load(df, paths[k], mode="overwrite")
    out = run.run_restaurant(spark, paths, pipelines.run_dir(spark))
    assert len(out) == 5 + 35  # five marts, 35 analyses (YTD comparison needs its years)
    assert all(r.reconciled for r in io.read_mart(spark, out["dq_mart_reconcile"]).collect())
    for name in ("rev_annual_pnl", "menu_category_margin", "kpi_daily", "server_revenue"):
        assert _same(io.read_mart(spark, out[name]), restaurant_queries.__dict__[f"q_{name}"](spark, SF_SMALL)), name


def test_bucketed_staging_removes_join_shuffles(spark):
    from tillroll.operators import hr_marts
    t = TestTables(spark, SF_SMALL)
    raw = {"employees": t.employees_raw(), "exit_records": t.exits_raw(),
           "attendance_monthly": t.attendance_raw(), "performance_reviews": t.reviews_raw()}
    stg = pipelines.bucketed_staging(spark, pipelines.hr_staging_layer(raw, AS_OF), 4)
    emp, ex = stg["stg_employees"], stg["stg_exit_records"]
    att, rv = stg["stg_attendance_monthly"], stg["stg_performance_reviews"]
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        mart = hr_marts.hr_employee_attrition(emp, ex, rv, att)
        mart.write.format("noop").mode("overwrite").save()
        plan = mart._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange hashpartitioning" not in plan
        lazy = q_hr_employee_attrition(spark, SF_SMALL)
        assert _same(mart, lazy)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_retail_runner_with_sales(spark):
    """Sales landed as Parquet -> year-partitioned working mart -> reports equal the lazy queries."""
    import os
    import tempfile

    from tillroll.plans import retail_queries, run
    from tillroll.sources import io, schemas
    t = TestTables(spark, SF_SMALL)
    land = tempfile.mkdtemp(prefix="tillroll-land-")
    io.bulk_load(t.store_sales(), f"{land}/sales", mode="overwrite")
    inv = f"{land}/inventory.csv"
    exp = f"{land}/expenses.csv"
    inv_df = t.store_inventory().selectExpr("store_id", "'' AS store_name", "'' AS borough", "'' AS owner", "category",
                                            "CAST(product AS STRING) AS product", "units_in_stock", "reorder_threshold",
                                            "unit_cost", "CAST(NULL AS DECIMAL(18,2)) AS stock_value", "'' AS status")
    inv_df.coalesce(1).write.option("header", True).csv(inv)
    exp_df = t.store_expenses().selectExpr("store_id", "'' AS store_name", "'' AS borough", "'' AS owner", "year", "month",
                                           "'' AS month_name", "rent", "labor", "utilities", "misc_expenses",
                                           "rent + labor + utilities + misc_expenses AS total_expenses")
    exp_df.coalesce(1).write.option("header", True).csv(exp)
    out = run.run_retail(spark, inv, exp, pipelines.run_dir(spark), f"{land}/sales")
    assert os.path.isdir(out["retail_daily"]) and any(d.startswith("year=") for d in os.listdir(out["retail_daily"]))
    for name in ("retail_kpis", "retail_by_store", "retail_monthly", "retail_net_profit", "retail_seasonality"):
        assert _same(io.read_mart(spark, out[name]), retail_queries.__dict__[f"q_{name}"](spark, SF_SMALL)), name


def _hr_exports(tmp_path):
    from tillroll.sources import schemas
    files = {}
    heads = {"employees": schemas.RAW_EMPLOYEES, "exits": schemas.RAW_EXIT_RECORDS, "reviews": schemas.RAW_PERFORMANCE_REVIEWS}
    rows = {"employees": [{"employee_id": i, "name": f"n{i}", "role": "Manager" if i == 1 else "Driver", "department": "d",
                           "hire_date": "2022-01-01", "termination_date": "2023-02-01" if i % 2 else "",
                           "termination_type": "Voluntary" if i % 2 else "", "hourly_rate": 20, "manager_id": "1.0",
                           "status": "Terminated" if i % 2 else "Active"} for i in range(1, 9)],
            "exits": [{"employee_id": i, "exit_date": "2023-02-01", "exit_reason": "Burnout", "exit_survey_score": 3,
                       "eligible_for_rehire": "Yes", "manager_id": "1.0"} for i in (1, 3, 5)],
            "reviews": [{"employee_id": 2, "review_period": "2022-H1", "score": 3.5, "promoted": "True", "manager_notes_tag": "Star"}]}
    for name, schema in heads.items():
        names = [f.name for f in schema.fields]
        lines = [",".join(names)] + [",".join(str(r.get(c, "")) for c in names) for r in rows[name]]
        if name == "exits":
            lines.append("bad id,not a date,Burnout,many,Yes,")
        files[name] = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    return files


def test_malformed_rows_are_counted_and_kept(spark, tmp_path):
    from tillroll.plans import run
    from tillroll.sources import io
    f = _hr_exports(tmp_path)
    paths = run.run_hr(spark, f["employees"], f["exits"], f["reviews"], "2026-04-30", out=str(tmp_path / "out"))
    counts = io.read_mart(spark, paths["landing_exit_records"]).collect()[0]
    assert (counts.rows, counts.corrupt_rows) == (4, 1)
    bad = io.read_mart(spark, paths["quarantine_exit_records"]).collect()
    assert [r[io.CORRUPT] for r in bad] == ["bad id,not a date,Burnout,many,Yes,"]


def test_marts_that_need_attendance_are_left_out(spark, tmp_path):
    from tillroll.plans import run
    f = _hr_exports(tmp_path)
    paths = run.run_hr(spark, f["employees"], f["exits"], f["reviews"], "2026-04-30", out=str(tmp_path / "out"))
    assert "mart_manager_scorecard" in paths and not set(pipelines.NEED_ATTENDANCE) & set(paths)
    assert not {"hr_rolling_rate", "ts_holt_winters", "hr_risk_levels"} & set(paths)
    assert spark.table("mart_manager_scorecard").count() == 1  # by name


def test_reconcile_finds_a_mart_that_loses_rows(spark):
    t = TestTables(spark, SF_SMALL)
    broken = {n: fn(t.sales()) for n, fn in marts.MARTS.items()}
    broken["daily_summary"] = broken["daily_summary"].filter("service = 'Dinner'")
    got = {r.mart: r.reconciled for r in marts.dq_mart_reconcile(t.sales(), broken).collect()}
    assert got.pop("daily_summary") is False and all(got.values())


def test_duplicate_menu_item_counts_per_dimension_row(spark):
    from tillroll.operators import menu
    sales = spark.createDataFrame([("x", "A", 10.0, 5.0)] * 2 + [("y", "A", 1.0, 1.0)], "item string, category string, line_total double, unit_price double")
    sales = sales.selectExpr("item", "category", "CAST(line_total AS DECIMAL(18,4)) line_total", "CAST(unit_price AS DECIMAL(18,4)) unit_price")
    dim = spark.createDataFrame([("x", 40.0), ("x", 60.0), ("y", 10.0)], "item string, gross_margin_pct double").selectExpr(
        "item", "CAST(gross_margin_pct AS DECIMAL(9,4)) gross_margin_pct")
    top = {r.item: (r.times_ordered, r.revenue, r.gross_margin_pct) for r in menu.menu_top_items(sales, dim).collect()}
    assert top == {"x": (4, 40.0, 50.0), "y": (1, 1.0, 10.0)}


def test_an_empty_store_list_selects_nothing(spark):
    from tillroll.operators import retail
    t = TestTables(spark, SF_SMALL)
    assert retail.retail_by_store(t.store_sales(), stores=[]).count() == 0
    assert retail.retail_by_store(t.store_sales(), stores=None).count() == 3


def test_only_checkpoints_need_a_shared_folder(monkeypatch):
    """A session on a cluster without the setting works until it checkpoints."""
    import pytest

    from tillroll import session

    class Fake:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Fake)


def test_cluster_settings_grow_with_the_input():
    from tillroll.session import cluster_conf
    small, large = (int(cluster_conf(tb)["spark.sql.shuffle.partitions"]) for tb in (1, 100))
    assert large > small
