"""HR staging, marts and reports on tiny fixtures (thresholds, edges)."""

import datetime as dt

from tillroll.operators import hr_marts, hr_reports, hr_staging

EMP_DDL = ("employee_id long, name string, role string, department string, hire_date string, termination_date string, "
           "termination_type string, hourly_rate double, manager_id string, status string")


def emps(spark):
    rows = [
        (1, "Mia Boss", "Manager", "Ops", "2020-01-01", None, None, 30.0, None, "Active"),
        (2, " Al ", "Driver", "Crew", "2021-01-01", "2022-01-01", "Voluntary", 18.125, "1.0", "Terminated"),
        (3, "Bea", "Driver", "Crew", "2021-06-01", None, None, 18.0, "1.0", "Active"),
        (4, "Cy", "Mover", "Crew", "not a date", None, None, 17.0, "1.0", "Active"),
        (5, "Di", "Mover", "Crew", "2023-01-01", "2023-03-01", "Voluntary", 17.0, "1.0", "Terminated"),
    ]
    return hr_staging.stg_employees(spark.createDataFrame(rows, EMP_DDL), "2024-01-01")


def exits(spark):
    rows = [(2, "2022-01-01", "Burnout", 2, "Yes"), (5, "2023-03-01", "INVOLUNTARY - No Show", 1, "No")]
    return hr_staging.stg_exits(spark.createDataFrame(
        rows, "employee_id long, exit_date string, exit_reason string, exit_survey_score int, eligible_for_rehire string"))


def attendance(spark):
    rows = [(3, "2023-09-01", 0, 0, 12, 1), (3, "2023-10-01", 20, 2, 15, 0), (3, "2023-12-01", 18, 4, 20, 2),
            (2, "2021-12-01", 20, 0, 30, 0)]
    return hr_staging.stg_attendance(spark.createDataFrame(
        rows, "employee_id long, month string, days_worked int, days_absent int, overtime_hours int, late_arrivals int"))


def reviews(spark):
    rows = [(3, "2022-H2", 4.0, "true", "Star"), (3, "2023-H1", 3.2, "False", "Reliable"),
            (3, "2023-H2", 2.5, "False", "At-Risk"), (2, "2021-H2", 3.0, "False", "Reliable"), (2, "bad", 1.0, "x", "?")]
    return hr_staging.stg_reviews(spark.createDataFrame(
        rows, "employee_id long, review_period string, score double, promoted string, manager_notes_tag string"))


def test_staging_casts(spark):
    e = {r.employee_id: r for r in emps(spark).collect()}
    assert e[2].name == "Al" and e[2].manager_id == 1 and e[2].hourly_rate == 18.13 and e[2].tenure_days == 365
    assert e[4].hire_date is None and e[4].tenure_days is None and e[1].manager_id is None
    x = {r.employee_id: r for r in exits(spark).collect()}
    assert x[5].exit_category == "Involuntary" and x[2].exit_category == "Voluntary" and x[5].exit_quarter == 1
    a = {(r.employee_id, r.month): r for r in attendance(spark).collect()}
    assert a[(3, dt.date(2023, 9, 1))].absence_rate is None
    assert [a[(3, dt.date(2023, m, 1))].high_overtime_flag for m in (9, 10, 12)] == [0, 1, 1]
    rv = {(r.employee_id, r.review_period): r for r in reviews(spark).collect()}
    assert rv[(3, "2022-H2")].review_date == dt.date(2022, 12, 31) and rv[(3, "2022-H2")].promoted == 1
    assert rv[(2, "bad")].review_date is None and rv[(2, "bad")].review_year is None


def test_latest_review_ignores_unparsed_period(spark):
    lr = {r.employee_id: r.last_review_score for r in hr_marts.hr_latest_review(reviews(spark)).collect()}
    assert lr == {3: 2.5, 2: 3.0}


def test_scorecard_thresholds(spark):
    sc = hr_marts.hr_manager_scorecard(emps(spark), exits(spark), attendance(spark)).collect()
    assert len(sc) == 1
    m = sc[0]
    assert (m.manager_name, m.team_size, m.total_exits, m.attrition_rate) == ("Mia Boss", 4, 2, 0.5)
    assert m.team_health_flag == "Watch" and m.burnout_exits == 1 and m.burnout_rate == 0.5


def test_scorecard_v1_fanout_weights(spark):
    v1 = hr_marts.hr_manager_scorecard_v1(emps(spark), exits(spark), attendance(spark), reviews(spark)).collect()[0]
    # employee 3 has 3 reviews, 2 has 2 (one unparsed), 4 and 5 one row each -> 3 + 2 + 1 + 1 rows
    assert v1.team_size == 7 and v1.total_terminations == 3
    assert v1.team_avg_review_score == round((4.0 + 3.2 + 2.5 + 3.0 + 1.0) / 5, 2)


def test_flight_risk_points(spark):
    fr = hr_marts.hr_flight_risk(emps(spark), reviews(spark), attendance(spark), "2024-01-01").collect()
    assert len(fr) == 1
    r = fr[0]
    # last two reviews 3.2 -> 2.5: faithful delta = max(3.2, 2.5) - max(prev) = 3.2 - 4.0 = -0.8 -> 35 points
    assert r.review_score_delta == -0.8 and r.current_review_score == 3.2
    # recent OT avg (12+15+20)/3 = 15.7 -> 15 points; tenure 30.5 months -> 5; absence avg(0.0909, 0.1818) -> 10
    assert r.flight_risk_score == 35 + 15 + 5 + 10 and r.flight_risk_label == "High"
    latest = hr_marts.hr_flight_risk(emps(spark), reviews(spark), attendance(spark), "2024-01-01", delta="latest").collect()[0]
    assert latest.review_score_delta == -0.7 and latest.current_review_score == 2.5


def test_trend_calendar_spine_keeps_gap_month(spark):
    att, ex = attendance(spark), exits(spark)
    a = {r.period_month for r in hr_marts.hr_monthly_trend(att, ex).collect()}
    c = {r.period_month: r for r in hr_marts.hr_monthly_trend(att, ex, "calendar").collect()}
    assert dt.date(2023, 11, 1) not in a and c[dt.date(2023, 11, 1)].active_headcount == 0
    assert c[dt.date(2023, 3, 1)].exits_count == 1 and c[dt.date(2023, 3, 1)].monthly_attrition_rate is None


def test_reports(spark):
    mart = hr_marts.hr_employee_attrition(emps(spark), exits(spark), reviews(spark), attendance(spark))
    k = hr_reports.hr_headline_kpis(mart).collect()[0]
    assert (k.total, k.terminated, k.active, k.overall_rate, k.voluntary) == (5, 2, 3, 40.0, 1)
    bands = hr_reports.hr_rate_by_tenure(mart).collect()
    assert len(bands) == 6 and bands[0].tenure_band == "0-3 months"
    piv = hr_reports.hr_reason_by_role(mart, hr_reports.exit_reasons(mart)).collect()
    assert {r.role: (r["Burnout"], r["INVOLUNTARY - No Show"]) for r in piv} == {"Driver": (1, 0), "Mover": (0, 1)}


def test_scorecard_flag_edges_and_no_exit_team(spark):
    rows = [(100, "M One", "Manager", "Ops", "2020-01-01", None, None, 30.0, None, "Active"),
            (101, "M Two", "Manager", "Ops", "2020-01-01", None, None, 30.0, None, "Active"),
            (102, "M Three", "Manager", "Ops", "2020-01-01", None, None, 30.0, None, "Active")]
    # team 100: 3 of 5 leave (0.60); team 101: 2 of 5 (0.40); team 102: nobody leaves
    for i in range(5):
        rows.append((200 + i, f"A{i}", "Driver", "Crew", "2021-01-01", "2022-01-01" if i < 3 else None,
                     "Voluntary" if i < 3 else None, 18.0, "100.0", "Terminated" if i < 3 else "Active"))
        rows.append((300 + i, f"B{i}", "Driver", "Crew", "2021-01-01", "2022-01-01" if i < 2 else None,
                     "Voluntary" if i < 2 else None, 18.0, "101.0", "Terminated" if i < 2 else "Active"))
        rows.append((400 + i, f"C{i}", "Mover", "Crew", "2021-01-01", None, None, 18.0, "102", "Active"))
    emp = hr_staging.stg_employees(spark.createDataFrame(rows, EMP_DDL), "2024-01-01")
    ex = exits(spark).filter("employee_id < 0")
    sc = {r.manager_id: r for r in hr_marts.hr_manager_scorecard(emp, ex, attendance(spark)).collect()}
    assert (sc[100].attrition_rate, sc[100].team_health_flag) == (0.6, "High Risk")
    assert (sc[101].attrition_rate, sc[101].team_health_flag) == (0.4, "Watch")
    assert (sc[102].total_exits, sc[102].burnout_rate, sc[102].team_health_flag) == (0, None, "Healthy")
    assert sc[100].avg_tenure_at_exit_months == 12.2


def test_flight_risk_left_keeps_staff_without_reviews(spark):
    inner = hr_marts.hr_flight_risk(emps(spark), reviews(spark), attendance(spark), "2024-01-01")
    left = hr_marts.hr_flight_risk(emps(spark), reviews(spark), attendance(spark), "2024-01-01", how="left")
    assert inner.count() == 1 and left.count() == 3


def test_ot_burnout_corr_without_spread_is_null(spark):
    def corr(*rows):
        df = spark.createDataFrame(rows, "avg_team_ot_hours double, burnout_rate double")
        return tuple(hr_reports.hr_ot_burnout_corr(df).first())

    assert corr((14.5, 0.1), (14.5, 0.2)) == (2, None)  # raised DIVIDE_BY_ZERO
    assert corr((14.5, 0.1), (14.6, 0.1), (14.7, 0.1)) == (3, None)
    assert corr((14.5, 0.1)) == (1, None) and corr() == (0, None)
    assert corr((1.0, 0.1), (2.0, 0.3), (3.0, 0.2), (9.0, None), (None, 0.9)) == (4, 0.5)  # of the pairs alone
