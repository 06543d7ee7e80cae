"""One-pass marts, working tables of the sales, published versions."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_restaurant import tiny_menu, tiny_res, tiny_sales, tiny_staff
from tillroll.operators import covers, kpi, marts, menu, quality, revenue, servers, working
from tillroll.plans import pipelines
from tillroll.sources import io, testdata
from tillroll.sources.testdata import TestTables


def same(a, b):
    key = sorted(a.columns)
    assert key == sorted(b.columns)
    return sorted(tuple(str(r[c]) for c in key) for r in a.collect()) == sorted(tuple(str(r[c]) for c in key) for r in b.collect())


def scans(df, of):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("+- == Initial Plan ==")[0]
    return sum(1 for line in final.splitlines() if re.search(r"Scan parquet|FileScan parquet", line) and of in line)


@pytest.mark.parametrize("name", marts.MARTS)
def test_cube_holds_every_mart(spark, name):
    for sales in (tiny_sales(spark), TestTables(spark, SF_SMALL).sales()):
        assert same(marts.mart_of(marts.mart_cube(sales), name), marts.MARTS[name](sales))


def test_cube_keeps_null_keys_apart_from_rolled_up_ones(spark):
    s = tiny_sales(spark).withColumns({c: F.lit(None).cast("string") for c in ("service", "category", "item")}).withColumn("date", F.lit(None).cast("date"))
    for name, fn in marts.MARTS.items():
        assert same(marts.mart_of(marts.mart_cube(s), name), fn(s))


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Sales as one Parquet table, so that scans of it can be counted."""
    path = str(tmp_path_factory.mktemp("land") / "sales_lines")
    TestTables(spark, SF_SMALL).sales().write.parquet(path)
    return spark.read.parquet(path)


def test_marts_reconcile_from_one_scan(spark, landed):
    got = marts.dq_mart_reconcile(landed)
    assert len(got.collect()) == 5 and all(r.reconciled for r in got.collect())
    assert scans(got, "sales_lines") == 1
    assert scans(marts.mart_cube(landed), "sales_lines") == 1


def test_working_tables_from_one_scan(spark, landed):
    assert scans(working.working_tables(landed), "sales_lines") == 1


def test_scorecard_reads_the_sales_once(spark, landed):
    t = TestTables(spark, SF_SMALL)
    assert scans(servers.server_revenue(landed, t.staff_dim(), t.reservations()), "sales_lines") == 1


REPORTS = {
    "orders": [revenue.rev_annual_pnl, revenue.rev_monthly_trend, revenue.rev_by_service_share, revenue.rev_by_weekday, covers.covers_hourly,
               covers.covers_peak_windows, lambda s: revenue.rev_ytd_compare(s, (2024, 2025), "03-01"), lambda s: quality.dq_frequent_keys(s, "order_id", 1)],
    "items": [revenue.rev_month_yoy, menu.menu_alcohol_share, menu.menu_discounts, quality.dq_price_band],
}


@pytest.mark.parametrize("grain", REPORTS)
def test_reports_read_working_tables_like_lines(spark, grain):
    sales = tiny_sales(spark)
    w = working.working_tables(sales)
    part = {"orders": working.orders_of, "items": working.items_of}[grain](w)
    for report in REPORTS[grain]:
        assert same(report(part), report(sales)), report


def test_joined_reports_read_working_tables_like_lines(spark):
    s, m, st, r = tiny_sales(spark), tiny_menu(spark), tiny_staff(spark), tiny_res(spark)
    w = working.working_tables(s, "Dolci")
    o, i = working.orders_of(w), working.items_of(w)
    assert same(menu.menu_category_margin(i, m), menu.menu_category_margin(s, m))
    assert same(menu.menu_top_items(i, m), menu.menu_top_items(s, m))
    assert same(menu.menu_worst_items(i, m), menu.menu_worst_items(s, m))
    assert same(servers.server_attach_rate(o, st), servers.server_attach_rate(s, st))
    labor = spark.createDataFrame([], "date date, labor_cost decimal(18,4), hours_worked decimal(9,2)")
    bought = spark.createDataFrame([], "date date, total_cost decimal(18,4)")
    for fanout in (False, True):
        assert same(servers.server_revenue(o, st, r, fanout), servers.server_revenue(s, st, r, fanout))
        assert same(covers.covers_revenue_per_cover(r, o, fanout), covers.covers_revenue_per_cover(r, s, fanout))
        assert same(kpi.kpi_daily(o, labor, bought, fanout), kpi.kpi_daily(s, labor, bought, fanout))
    cols = ["order_id", "date", "line_total", "category", "server_id", "is_alcohol"]
    assert same(working.null_counts(w), quality.dq_null_counts(s, cols))


def test_runner_reads_the_sales_lines_twice(spark, landed, tmp_path):
    """Of all that the runner writes, two plans read the lines."""
    seen = []
    for df in (marts.mart_cube(landed), working.working_tables(landed)):
        seen.append(scans(df, "sales_lines"))
    out = str(tmp_path / "run")
    pipelines.build_restaurant_marts(spark, landed, out)
    w = pipelines.build_working(spark, landed, out)
    from tillroll.plans import run
    t = TestTables(spark, SF_SMALL)
    reports = run.restaurant_reports({"reservations": t.reservations(), "purchases": t.purchases(), "labor": t.labor(), "guests": t.guests(),
                                      "menu": t.menu_dim(), "staff": t.staff_dim()}, w)
    assert seen == [1, 1]
    for name, df in reports.items():
        assert not any("sales_lines" in f for f in df.inputFiles()), name


# published versions

def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "mart")
    first = io.publish_mart(spark.range(10).toDF("n"), path)
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("n"))
    with pytest.raises(Exception, match="lost"):
        io.publish_mart(broken, path)
    assert io.current_version(spark, path) == first
    assert sorted(r.n for r in io.read_mart(spark, path).collect()) == list(range(10))


def test_an_unswapped_version_is_not_read(spark, tmp_path):
    """The driver is lost after the data is written, before the swap."""
    path = str(tmp_path / "mart")
    io.publish_mart(spark.range(3).toDF("n"), path)
    spark.range(50).toDF("n").write.parquet(f"{path}/v999999999999999-dead")
    assert io.read_mart(spark, path).count() == 3
    io.publish_mart(spark.range(4).toDF("n"), path)
    assert io.read_mart(spark, path).count() == 4


def test_readers_keep_their_version_and_old_ones_go(spark, tmp_path):
    import os
    path = str(tmp_path / "mart")
    assert io.current_version(spark, path) is None
    io.publish_mart(spark.range(1).selectExpr("id AS n", "2024 AS year"), path, ["year"])
    reader = io.read_mart(spark, path)
    io.publish_mart(spark.range(2).selectExpr("id AS n", "2025 AS year"), path, ["year"])
    assert reader.count() == 1 and io.read_mart(spark, path).count() == 2
    for k in range(3, 6):
        io.publish_mart(spark.range(k).selectExpr("id AS n", "2025 AS year"), path, ["year"])
    assert io.read_mart(spark, path).count() == 5
    assert len([d for d in os.listdir(path) if d.startswith("v")]) == 2


def dealt(df):
    """Tasks to which an executed plan deals lines and orders, by count."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(r"hashpartitioning\([lo]_orderkey#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}


def test_item_performance_of_many_lines_takes_more_tasks(spark, monkeypatch):
    whole = marts.mart_item_performance(TestTables(spark, SF_SMALL).sales())
    assert dealt(whole) == set()  # few lines: left to AQE
    monkeypatch.setattr(testdata, "TASK_LINES", 500)
    many = marts.mart_item_performance(TestTables(spark, SF_SMALL + "/.").sales())
    assert dealt(many) == {-(-TestTables(spark, SF_SMALL).t("lineitem").count() // 500)}
    assert same(many, whole)


def test_duplicate_rows_of_many_lines_take_more_tasks(spark, monkeypatch):
    import __spark_entry__

    query = __spark_entry__.queries()["dq_duplicate_rows"]
    whole = query(spark, SF_SMALL)
    monkeypatch.setattr(testdata, "TASK_LINES", 500)
    many = query(spark, SF_SMALL + "/./.")
    assert dealt(many) == {-(-TestTables(spark, SF_SMALL).t("lineitem").count() // 500)}
    assert same(many, whole)


def test_duplicate_rows_of_many_lines_are_grouped_in_more_tasks(spark, monkeypatch):
    import __spark_entry__

    query = __spark_entry__.queries()["dq_duplicate_rows"]

    def grouped(df):
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        return {int(n) for n in re.findall(r"hashpartitioning\(order_id#[^)]*, (\d+)\)", plan)}
    whole = query(spark, SF_SMALL)
    monkeypatch.setattr(testdata, "TASK_LINES", 500)
    many = query(spark, SF_SMALL + "/././.")
    tasks = -(-TestTables(spark, SF_SMALL).t("lineitem").count() // 500)
    assert tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert grouped(whole) == {int(spark.conf.get("spark.sql.shuffle.partitions"))} and grouped(many) == {tasks}
    assert whole.count() and same(many, whole)
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None), (None, None), (2, "a")], "n int, s string")
    assert sorted(map(str, quality.dq_duplicate_rows(rows, tasks=7).collect())) == sorted(map(str, quality.dq_duplicate_rows(rows).collect()))


def test_reconciling_groups_by_no_order(spark):
    sales = tiny_sales(spark)
    got = marts.dq_mart_reconcile(sales)
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", got._jdf.queryExecution().executedPlan().toString())
    assert keys and not any("order_id" in k or "reservation_id" in k for k in keys)
    lines = marts.mart_cube(sales, counts=False)
    assert same(lines, marts.mart_cube(sales).select(*lines.columns))
