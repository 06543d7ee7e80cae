"""Run the layered pipelines from CSV exports, as the reference's users do:
typed RAW landing (declared schema, PERMISSIVE) -> staging views -> marts
written once under the shared folder -> report tables written next to them.

    python -m tillroll.plans.run hr --employees E.csv --exits X.csv --reviews R.csv \\
        [--attendance A.csv] --as-of 2026-04-30 [--out DIR]
    python -m tillroll.plans.run retail --inventory I.csv --expenses X.csv [--out DIR]
    python -m tillroll.plans.run restaurant --sales S --reservations R --purchases P --labor L \
        --guests G --menu M.csv --staff T.csv [--out DIR]
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillroll.operators import cost, covers, guests, kpi, marts, menu, quality, retail, revenue, servers, working
from tillroll.plans import pipelines
from tillroll.sources import io, schemas


def land(spark: SparkSession, name: str, path: str, schema, out: str, paths: dict[str, str]):
    """One export of the RAW layer: Parquet as it is, CSV typed by the
    declared schema. Of a CSV the landing counts (rows, rows that did not
    parse, NULLs per column) go to reports/landing_<name> and the rows that
    did not parse, with their text, to quarantine/<name>; downstream they
    keep the fields that could be read."""
    if not path.lower().endswith(".csv"):
        df = spark.read.parquet(path)
    else:
        full = io.read_csv(spark, path, schema)
        for kind, found in ((f"landing_{name}", io.landing_counts(full)), (f"quarantine_{name}", io.corrupt_rows(full))):
            paths[kind] = f"{out}/reports/{kind}" if kind.startswith("landing") else f"{out}/quarantine/{name}"
            io.write_mart(found, paths[kind])
        df = full.drop(io.CORRUPT)
    io.register_view(df, f"raw_{name}")
    return df


def land_hr(spark: SparkSession, employees: str, exits: str, reviews: str, attendance: str | None, out: str, paths: dict[str, str]):
    """RAW layer from the four HR exports; without an attendance export its
    entry is None."""
    files = {"employees": (employees, schemas.RAW_EMPLOYEES), "exit_records": (exits, schemas.RAW_EXIT_RECORDS),
             "performance_reviews": (reviews, schemas.RAW_PERFORMANCE_REVIEWS), "attendance_monthly": (attendance, schemas.RAW_ATTENDANCE_MONTHLY)}
    return {name: land(spark, name, path, schema, out, paths) if path else None for name, (path, schema) in files.items()}


def run_hr(spark: SparkSession, employees: str, exits: str, reviews: str, as_of: str | dt.date,
           attendance: str | None = None, out: str | None = None, buckets: int | None = None) -> dict[str, str]:
    """Build the HR marts and the report tables; returns name -> path.
    ``buckets`` writes the staging layer bucketed by employee_id first.
    Without ``attendance`` the marts that need it (monthly trend, flight
    risk) and their reports are left out, not written empty."""
    out = out or pipelines.run_dir(spark)
    paths: dict[str, str] = {}
    raw = land_hr(spark, employees, exits, reviews, attendance, out, paths)
    paths |= pipelines.build_hr_marts(spark, raw, as_of, out, bucket_staging=buckets)
    for name, df in pipelines.hr_reports_from_marts(spark, paths).items():
        p = f"{out}/reports/{name}"
        io.write_mart(df, p)
        paths[name] = p
    return paths


def run_retail(spark: SparkSession, inventory: str, expenses: str, out: str | None = None,
               sales: str | None = None) -> dict[str, str]:
    """Stock status / value and the expense check from the retail exports;
    with ``sales`` (Parquet: store_id, date, category, product, units,
    revenue, cost) also the (store, category, date) working mart, written
    partitioned by year, and every dashboard report computed from it."""
    out = out or pipelines.run_dir(spark)
    paths: dict[str, str] = {}
    inv = land(spark, "store_inventory", inventory, schemas.STORE_INVENTORY, out, paths)
    exp = land(spark, "store_expenses", expenses, schemas.STORE_EXPENSES, out, paths)
    built = {"retail_stock_status": retail.retail_stock_status(inv), "retail_stock_value": retail.retail_stock_value(inv),
             "retail_expense_check": retail.retail_expense_check(exp)}
    if sales:
        mp = f"{out}/marts/retail_daily"
        io.write_mart(retail.retail_daily_mart(spark.read.parquet(sales)).withColumn("year", F.year("date")), mp, ["year"])
        paths["retail_daily"] = mp
        m = spark.read.parquet(mp).drop("year")
        built.update({
            "retail_kpis": retail.retail_kpis(m), "retail_by_store": retail.retail_by_store(m),
            "retail_by_category": retail.retail_by_category(m), "retail_gross_profit": retail.retail_gross_profit(m),
            "retail_monthly": retail.retail_monthly(m), "retail_net_profit": retail.retail_net_profit(m, exp),
            "retail_labor_ratio": retail.retail_labor_ratio(m, exp), "retail_category_rank": retail.retail_category_rank(m),
            "retail_yoy": retail.retail_yoy(m), "retail_seasonality": retail.retail_seasonality(m),
            "retail_shelf_productivity": retail.retail_shelf_productivity(m, inv),
        })
    for name, df in built.items():
        p = f"{out}/reports/{name}"
        io.write_mart(df, p)
        paths[name] = p
    return paths


RESTAURANT_SCHEMAS = {
    "sales": schemas.SALES_TRANSACTIONS, "reservations": schemas.RESERVATIONS,
    "purchases": schemas.INVENTORY_PURCHASES, "labor": schemas.LABOR_HOURS, "guests": schemas.GUEST_PROFILES,
    "menu": schemas.MENU_DIM, "staff": schemas.STAFF_DIM,
}


def restaurant_reports(t: dict, w: dict) -> dict:
    """Every restaurant analysis as a lazy DataFrame: what the sales are
    asked goes to the coarsest working table (``w``) that can answer it."""
    r, p, lab, g, m, st = (t[k] for k in ("reservations", "purchases", "labor", "guests", "menu", "staff"))
    s, i = w["orders"], w["items"]
    daily = kpi.kpi_daily(s, lab, p)
    return {
        "dq_table_profile": quality.dq_table_profile({"sales_transactions": (s, "date"), "reservations": (r, "date"),
                                                      "inventory_purchases": (p, "date"), "labor_hours": (lab, "date")}),
        "dq_null_counts": working.null_counts(w["both"]),
        "dq_orphan_keys": quality.dq_orphan_keys(s, "server_id", st, "employee_id"),
        "dq_price_band": quality.dq_price_band(i), "dq_frequent_keys": quality.dq_frequent_keys(s),
        "rev_annual_pnl": revenue.rev_annual_pnl(s), "rev_monthly_trend": revenue.rev_monthly_trend(s),
        "rev_by_service_share": revenue.rev_by_service_share(s), "rev_by_weekday": revenue.rev_by_weekday(s),
        "rev_month_yoy": revenue.rev_month_yoy(i),
        "menu_category_margin": menu.menu_category_margin(i, m), "menu_top_items": menu.menu_top_items(i, m),
        "menu_worst_items": menu.menu_worst_items(i, m), "menu_alcohol_share": menu.menu_alcohol_share(i),
        "menu_discounts": menu.menu_discounts(i),
        "covers_capacity": covers.covers_capacity(r), "covers_revenue_per_cover": covers.covers_revenue_per_cover(r, s),
        "covers_by_channel": covers.covers_by_channel(r), "covers_hourly": covers.covers_hourly(s),
        "covers_peak_windows": covers.covers_peak_windows(s),
        "pnl_monthly": cost.pnl_monthly(i, p, lab), "cost_by_supplier": cost.cost_by_supplier(p),
        "cost_inflation": cost.cost_inflation(p), "labor_by_role": cost.labor_by_role(lab),
        "server_revenue": servers.server_revenue(s, st, r), "server_attach_rate": servers.server_attach_rate(s, st),
        "guest_segments": guests.guest_segments(g), "guest_by_town": guests.guest_by_town(g),
        "guest_cohorts": guests.guest_cohorts(g), "guest_segment_ratio": guests.guest_segment_ratio(g),
        "guest_town_rank": guests.guest_town_rank(g),
        "kpi_daily": daily, "kpi_day_type": kpi.kpi_day_type(daily),
    }


def run_restaurant(spark: SparkSession, paths: dict[str, str], out: str | None = None,
                   ytd_years=None, ytd_cutoff: str | None = None, attach_category: str = "Dolci") -> dict[str, str]:
    """Land the seven restaurant tables, write the working tables and the
    five marts, reconcile them, and write every analysis result; returns
    name -> path. The sales lines are read twice: for the working tables and
    for the marts."""
    out = out or pipelines.run_dir(spark)
    written: dict[str, str] = {}
    t = {k: land(spark, k, v, RESTAURANT_SCHEMAS[k], out, written) for k, v in paths.items()}
    made = pipelines.build_restaurant_marts(spark, t["sales"], out)
    written |= made
    w = pipelines.build_working(spark, t["sales"], out, attach_category)
    reports = restaurant_reports(t, w)
    reports["dq_mart_reconcile"] = marts.dq_mart_reconcile(w["orders"], pipelines.read_marts(spark, made))
    if ytd_years:
        reports["rev_ytd_compare"] = revenue.rev_ytd_compare(w["orders"], ytd_years, ytd_cutoff or "12-31")
    reports["guest_pareto"] = guests.guest_pareto(t["guests"])
    for name, df in reports.items():
        p = f"{out}/reports/{name}"
        io.write_mart(df, p)
        written[name] = p
    return written


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tillroll.plans.run")
    sub = ap.add_subparsers(dest="cmd", required=True)
    h = sub.add_parser("hr")
    h.add_argument("--employees", required=True)
    h.add_argument("--exits", required=True)
    h.add_argument("--reviews", required=True)
    h.add_argument("--attendance")
    h.add_argument("--as-of", required=True)
    h.add_argument("--out")
    h.add_argument("--buckets", type=int, help="bucket the staging tables by employee_id")
    r = sub.add_parser("retail")
    r.add_argument("--inventory", required=True)
    r.add_argument("--expenses", required=True)
    r.add_argument("--sales", help="Parquet sales lines (store_id, date, category, product, units, revenue, cost)")
    r.add_argument("--out")
    x = sub.add_parser("restaurant")
    for k in RESTAURANT_SCHEMAS:
        x.add_argument(f"--{k}", required=True)
    x.add_argument("--ytd-years", help="e.g. 2025,2026 for the like-for-like year-to-date comparison")
    x.add_argument("--ytd-cutoff", default="12-31", help="MM-DD, inclusive")
    x.add_argument("--out")
    for p in (h, r, x):
        p.add_argument("--input-tb", type=float, help="size the shuffles for so much input")
        p.add_argument("--executors", type=int, default=1000)
    a = ap.parse_args(argv)
    from tillroll.session import get_spark
    spark = get_spark(input_tb=a.input_tb, executors=a.executors)
    if a.cmd == "hr":
        paths = run_hr(spark, a.employees, a.exits, a.reviews, a.as_of, a.attendance, a.out, a.buckets)
    elif a.cmd == "retail":
        paths = run_retail(spark, a.inventory, a.expenses, a.out, a.sales)
    else:
        years = tuple(int(y) for y in a.ytd_years.split(",")) if a.ytd_years else None
        paths = run_restaurant(spark, {k: getattr(a, k) for k in RESTAURANT_SCHEMAS}, a.out, years, a.ytd_cutoff)
    for k, v in paths.items():
        print(f"{k}\t{v}")


if __name__ == "__main__":
    main()
