"""Invariants on random small sales tables (hypothesis)."""

import datetime as dt
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillroll.operators import covers, kpi, marts, revenue

DDL = ("order_id long, reservation_id long, date date, service string, hour int, party_size int, category string, "
       "item string, unit_price decimal(18,4), qty int, discount_pct decimal(9,4), line_total decimal(18,4), "
       "is_alcohol string, server_id string, res_type string")

line = st.tuples(
    st.integers(1, 12),                                  # order
    st.integers(0, 400),                                 # day offset
    st.sampled_from(["Lunch", "Dinner"]),
    st.sampled_from(["Pasta", "Wine", "Dolci"]),
    st.integers(1, 9999),                                # cents
    st.integers(1, 6),                                   # party size
)


def frame(spark, rows, one_line_per_res=False):
    out = []
    for i, (order, day, service, cat, cents, party) in enumerate(rows):
        res = (1000 + i) if one_line_per_res else order  # a reservation per order, or per line
        d = dt.date(2023, 1, 1) + dt.timedelta(days=day)
        amount = Decimal(cents) / 100
        out.append((order if not one_line_per_res else 5000 + i, res, d, service, 12, party, cat, cat + "1", amount, 1,
                    Decimal("0"), amount, "Yes" if cat == "Wine" else "No", "E1", "Reservation"))
    return spark.createDataFrame(out, DDL)


SET = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SET
@given(st.lists(line, min_size=1, max_size=25))
def test_shares_and_reconcile(spark, rows):
    s = frame(spark, rows)
    by_year = {}
    for r in revenue.rev_by_service_share(s).collect():
        by_year.setdefault(r.year, []).append(r.revenue_share_pct)
    for shares in by_year.values():
        assert abs(sum(shares) - 100) <= 0.05 * len(shares) + 1e-9
    assert all(r.reconciled for r in marts.dq_mart_reconcile(s).collect())
    total = sum(Decimal(str(r.line_total)) for r in s.collect())
    daily = sum(Decimal(str(r.revenue)) for r in kpi.kpi_daily(s, s.limit(0).selectExpr(
        "date", "CAST(0 AS DECIMAL(18,4)) AS labor_cost", "CAST(0 AS DECIMAL(9,2)) AS hours_worked"),
        s.limit(0).selectExpr("date", "line_total AS total_cost")).collect())
    assert abs(daily - total) <= Decimal("0.005") * len(rows)


@SET
@given(st.lists(line, min_size=1, max_size=25))
def test_fixed_equals_fanout_on_one_line_reservations(spark, rows):
    s = frame(spark, rows, one_line_per_res=True)
    res = s.selectExpr("reservation_id", "date", "service", "party_size", "server_id", "res_type")
    a = sorted(tuple(r) for r in covers.covers_revenue_per_cover(res, s).collect())
    b = sorted(tuple(r) for r in covers.covers_revenue_per_cover(res, s, fanout=True).collect())
    assert a == b


@SET
@given(st.lists(line, min_size=1, max_size=20), st.lists(line, min_size=1, max_size=10))
def test_other_groups_do_not_change_a_group(spark, rows, extra):
    base = frame(spark, [r for r in rows if r[3] != "Dolci"])
    more = frame(spark, [r for r in rows if r[3] != "Dolci"] + [(o + 100, d, sv, "Dolci", c, p) for o, d, sv, _, c, p in extra])
    a = {(r.year, r.month, r.category): tuple(r) for r in marts.mart_category_monthly(base).collect()}
    b = {(r.year, r.month, r.category): tuple(r) for r in marts.mart_category_monthly(more).collect() if r.category != "Dolci"}
    assert a == b
