"""Restaurant operators on tiny hand-made fixtures (edge rules)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tillroll.operators import covers, kpi, marts, menu, quality, revenue, servers

SALES_DDL = ("order_id long, reservation_id long, date date, service string, hour int, party_size int, "
             "category string, item string, unit_price decimal(18,4), qty int, discount_pct decimal(9,4), "
             "line_total decimal(18,4), is_alcohol string, server_id string, res_type string")


def tiny_sales(spark):
    d1, d2 = dt.date(2024, 3, 1), dt.date(2025, 3, 1)
    rows = [
        # order 1 with two lines on reservation 10 (party of 4)
        (1, 10, d1, "Dinner", 18, 4, "Pasta", "Carbonara", D("20"), 2, D("0"), D("40"), "No", "E1", "Reservation"),
        (1, 10, d1, "Dinner", 18, 4, "Wine", "Chianti", D("30"), 1, D("0.1"), D("27"), "Yes", "E1", "Reservation"),
        # order without reservation, NULL server
        (2, None, d1, "Lunch", 12, 2, "Dolci", "Tiramisu", D("10"), 1, D("0"), D("10"), "No", None, "Walk-in"),
        # category with no dim row
        (3, 11, d2, "Dinner", 19, 2, "Secret", "Mystery", D("50"), 1, D("0"), D("50"), "No", "E2", "Reservation"),
    ]
    return spark.createDataFrame(rows, SALES_DDL)


def tiny_res(spark):
    return spark.createDataFrame([(10, dt.date(2024, 3, 1), "Dinner", 4, "E1", "Reservation"),
                                  (11, dt.date(2025, 3, 1), "Dinner", 2, "E2", "Reservation"),
                                  (12, dt.date(2025, 3, 2), "Dinner", 3, "E2", "Walk-in")],
                                 "reservation_id long, date date, service string, party_size int, server_id string, res_type string")


def tiny_menu(spark):
    return spark.createDataFrame([("Carbonara", "Pasta", D("0.3"), D("70")), ("Chianti", "Wine", D("0.25"), D("75")),
                                  ("Tiramisu", "Dolci", D("0.2"), D("80"))],
                                 "item string, category string, cogs_pct decimal(9,4), gross_margin_pct decimal(9,4)")


def tiny_staff(spark):
    return spark.createDataFrame([("E1", "Ann", "Server"), ("E2", "Bo", "Bartender")], "employee_id string, name string, role string")


def test_annual_pnl_growth_and_shares(spark):
    r = {x.year: x for x in revenue.rev_annual_pnl(tiny_sales(spark)).collect()}
    assert r[2024].gross_revenue == 77.0 and r[2024].total_checks == 2 and r[2024].covers == 1
    assert r[2024].alcohol_pct == 35.1 and r[2024].yoy_growth_pct is None
    assert r[2025].yoy_growth_pct == round((50 - 77) / 77 * 100, 1)
    assert r[2024].discounts_given == 2.7


def test_category_margin_keeps_unmatched_category(spark):
    rows = {x.category: x for x in menu.menu_category_margin(tiny_sales(spark), tiny_menu(spark)).collect()}
    assert rows["Secret"].avg_cogs_pct is None and rows["Secret"].est_gross_profit is None
    assert abs(sum(x.revenue_share_pct for x in rows.values()) - 100) < 0.3


def test_revenue_per_cover_counts_party_once(spark):
    fixed = covers.covers_revenue_per_cover(tiny_res(spark), tiny_sales(spark)).collect()
    fan = covers.covers_revenue_per_cover(tiny_res(spark), tiny_sales(spark), fanout=True).collect()
    f = {(x.service, x.day_of_week): x.total_covers for x in fixed}
    g = {(x.service, x.day_of_week): x.total_covers for x in fan}
    assert f[("Dinner", "Friday")] == 4 and g[("Dinner", "Friday")] == 8


def test_server_revenue_null_server_and_fanout(spark):
    s, st, r = tiny_sales(spark), tiny_staff(spark), tiny_res(spark)
    fixed = {x.server_id: x for x in servers.server_revenue(s, st, r).collect()}
    fan = {x.server_id: x for x in servers.server_revenue(s, st, r, fanout=True).collect()}
    assert fixed["E1"].covers_served == 4 and fan["E1"].covers_served == 8
    assert None in fixed and fixed[None].server_name is None and fixed[None].covers_served is None


def test_attach_rate_role_filter(spark):
    rows = servers.server_attach_rate(tiny_sales(spark), tiny_staff(spark), "Server", "Dolci").collect()
    assert [(x.server_id, x.checks, x.checks_with_alcohol, x.alcohol_attach_pct) for x in rows] == [("E1", 1, 1, 100.0)]


def test_orphans_and_frequent_keys(spark):
    s = tiny_sales(spark)
    orphans = {x.server_id for x in quality.dq_orphan_keys(s, "server_id", tiny_staff(spark).filter("employee_id = 'E1'"),
                                                           "employee_id").collect()}
    assert orphans == {None, "E2"}
    assert [(x.order_id, x.occurrences) for x in quality.dq_frequent_keys(s, "order_id", 1).collect()] == [(1, 2)]


def test_mart_reconcile(spark):
    assert all(x.reconciled for x in marts.dq_mart_reconcile(tiny_sales(spark)).collect())


def test_kpi_daily_zero_labour_and_cogs(spark):
    empty_labor = spark.createDataFrame([], "date date, labor_cost decimal(18,4), hours_worked decimal(9,2)")
    empty_purch = spark.createDataFrame([], "date date, total_cost decimal(18,4)")
    rows = kpi.kpi_daily(tiny_sales(spark), empty_labor, empty_purch).collect()
    d = {x.date: x for x in rows}[dt.date(2024, 3, 1)]
    assert d.labor_cost == 0.0 and d.cogs == 0.0 and d.operating_profit == 77.0 and d.margin_pct == 100.0
    assert d.total_guests == 6 and d.week_num == "09"


def test_ytd_window(spark):
    rows = revenue.rev_ytd_compare(tiny_sales(spark), (2024, 2025), "02-28").collect()
    assert rows == []
    rows = revenue.rev_ytd_compare(tiny_sales(spark), (2024, 2025), "03-01").collect()
    assert [x.year for x in rows] == [2024, 2025]
