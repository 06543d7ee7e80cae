"""HR marts (H5-H13): attrition fact, monthly trend, manager scorecards,
flight-risk scores.

All joins are on ``employee_id``, so they share one hash partitioning.
Reviews and attendance are reduced to one row per employee first; exit rows
are joined as they are, so an employee with two exit rows has two mart rows
(as in the reference).
The v1 scorecard reproduces the reference's per-review fan-out with row
weights instead of materialising the fan-out join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.banding import tenure_band
from tillroll.functions.numeric import ratio, to_dec
from tillroll.functions.ranking import latest_by
from tillroll.functions.windows import fill_month_gaps

# Flight-risk points (threshold, points) checked in order, and labels.
SCORE_DELTA_POINTS = [(-0.5, 35), (0.0, 20)]          # delta < threshold
OVERTIME_POINTS = [(20, 25), (12, 15)]                 # recent avg OT >= threshold
ABSENCE_POINTS = [(0.15, 20), (0.08, 10)]              # recent absence rate >= threshold
TENURE_POINTS_IN_RANGE, TENURE_POINTS_SHORT, TENURE_POINTS_LONG = 20, 10, 5   # 12-30 months, < 12, else
RISK_LABELS = [(60, "High"), (35, "Medium")]           # score >= threshold, else "Low"
HEALTH_FLAGS = [(0.60, "High Risk"), (0.40, "Watch")]  # attrition >= threshold, else "Healthy"


def tenure_months(days="tenure_days") -> Column:
    return ratio(days, F.lit(30.0), 1)


def _tenure_months_dec(days="tenure_days") -> Column:
    """Same rounding kept exact (decimal) for later averaging."""
    c = F.col(days) if isinstance(days, str) else days
    return F.round((c.cast("double") / F.lit(30.0)).cast("decimal(38,8)"), 1)


def hr_latest_review(reviews: DataFrame) -> DataFrame:
    """Most recent review per employee (ties on date: later period label)."""
    latest = latest_by(reviews, ["employee_id"], [F.desc_nulls_last("review_date"), F.desc_nulls_last("review_period")])
    return latest.select("employee_id", F.col("score").alias("last_review_score"),
                         F.col("manager_notes_tag").alias("last_review_tag"))


def hr_attendance_avg(att: DataFrame) -> DataFrame:
    a = att.groupBy("employee_id").agg(
        F.sum("overtime_hours").alias("_ot"), F.count("overtime_hours").alias("_otn"),
        F.sum(to_dec("absence_rate")).alias("_ab"), F.count("absence_rate").alias("_abn"),
        F.sum("late_arrivals").alias("_la"), F.count("late_arrivals").alias("_lan"))
    return a.select("employee_id", ratio("_ot", "_otn", 1).alias("avg_monthly_ot"),
                    ratio("_ab", "_abn", 4).alias("avg_absence_rate"),
                    ratio("_la", "_lan", 1).alias("avg_late_arrivals"))


def hr_employee_attrition(emp: DataFrame, exits: DataFrame, reviews: DataFrame, att: DataFrame) -> DataFrame:
    """One row per employee ever: tenure, band, exit, last review, attendance."""
    x = exits.select("employee_id", "exit_reason", "exit_category", "exit_survey_score", "eligible_for_rehire",
                     "exit_month", "exit_year")
    j = (emp.join(x, "employee_id", "left").join(hr_latest_review(reviews), "employee_id", "left")
         .join(hr_attendance_avg(att), "employee_id", "left"))
    return j.select(
        "employee_id", "name", "role", "department", "hire_date", "termination_date", "termination_type",
        "hourly_rate", "manager_id", "status", "is_terminated", "tenure_days",
        tenure_months().alias("tenure_months"), tenure_band("tenure_days").alias("tenure_band"),
        "exit_reason", "exit_category", "exit_survey_score", "eligible_for_rehire", "exit_month", "exit_year",
        "last_review_score", "last_review_tag", "avg_monthly_ot", "avg_absence_rate", "avg_late_arrivals")


def hr_monthly_trend(att: DataFrame, exits: DataFrame, spine: str = "attendance") -> DataFrame:
    """Headcount (distinct staff with attendance) and exits per month.

    ``spine="attendance"`` keeps only months with attendance rows (the
    reference); ``"calendar"`` keeps every month between the first and last
    month seen in either input, with zero headcount where none."""
    hc = (att.filter(F.col("month").isNotNull()).groupBy(F.col("month").alias("period_month"))
          .agg(F.countDistinct("employee_id").alias("active_headcount")))
    ex = (exits.groupBy(F.trunc("exit_date", "month").alias("period_month"))
          .agg(F.count(F.lit(1)).alias("_x"),
               F.sum(F.when(F.col("exit_category") == "Voluntary", 1).otherwise(0)).alias("_v"),
               F.sum(F.when(F.col("exit_category") == "Involuntary", 1).otherwise(0)).alias("_i")))
    if spine == "attendance":
        j = hc.join(ex, "period_month", "left")
    elif spine == "calendar":
        # months seen in either input, then the gaps between them (bounded by the calendar)
        j = fill_month_gaps(hc.join(ex, "period_month", "full"), "period_month") \
            .withColumn("active_headcount", F.coalesce("active_headcount", F.lit(0)).cast("bigint"))
    else:
        raise ValueError(spine)
    x = F.coalesce(F.col("_x"), F.lit(0)).cast("bigint")
    return j.select(
        "period_month", F.year("period_month").alias("year"), F.month("period_month").alias("month_num"),
        "active_headcount", x.alias("exits_count"),
        F.coalesce(F.col("_v"), F.lit(0)).cast("bigint").alias("voluntary_exits"),
        F.coalesce(F.col("_i"), F.lit(0)).cast("bigint").alias("involuntary_exits"),
        ratio(x, "active_headcount", 4).alias("monthly_attrition_rate"),
    ).orderBy("period_month")


def hr_monthly_trend_v1(exits: DataFrame, emp: DataFrame) -> DataFrame:
    j = exits.join(emp.select("employee_id", "tenure_days"), "employee_id")
    a = j.groupBy("exit_year", "exit_month", "exit_category").agg(
        F.count(F.lit(1)).alias("exits"), F.sum("exit_survey_score").alias("_s"), F.count("exit_survey_score").alias("_sn"),
        F.sum("tenure_days").alias("_t"), F.count("tenure_days").alias("_tn"))
    return a.select("exit_year", "exit_month", "exit_category", "exits",
                    ratio("_s", "_sn", 2).alias("avg_exit_survey_score"),
                    ratio("_t", "_tn", 0).alias("avg_tenure_days_at_exit"))


def _cascade(x: Column, table, cmp: str, otherwise):
    expr = None
    for thr, val in table:
        cond = (x < thr) if cmp == "<" else (x >= thr)
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(otherwise))


def hr_manager_scorecard(emp: DataFrame, exits: DataFrame, att: DataFrame, flags=HEALTH_FLAGS) -> DataFrame:
    ot = att.groupBy("employee_id").agg(ratio(F.sum("overtime_hours"), F.count("overtime_hours"), 1).alias("avg_monthly_ot"))
    e = (emp.filter(F.col("manager_id").isNotNull())
         .join(exits.select("employee_id", "exit_reason"), "employee_id", "left")
         .join(ot, "employee_id", "left"))
    term = F.col("is_terminated") == 1
    burn = F.when(F.col("exit_reason") == "Burnout", 1).otherwise(0)
    ts = e.groupBy("manager_id").agg(
        F.countDistinct("employee_id").alias("team_size"), F.sum("is_terminated").alias("total_exits"),
        F.sum(F.when(term, _tenure_months_dec())).alias("_ten"), F.count(F.when(term, _tenure_months_dec())).alias("_tenn"),
        F.sum(burn).alias("burnout_exits"),
        F.sum(to_dec("avg_monthly_ot")).alias("_ot"), F.count("avg_monthly_ot").alias("_otn"))
    mgr = emp.filter(F.col("role") == "Manager").select(F.col("employee_id").alias("_mid"),
                                                         F.col("name").alias("manager_name"))
    j = ts.join(mgr, F.col("manager_id") == F.col("_mid"), "left")
    rate = ratio("total_exits", "team_size", 4)
    out = j.select(
        "manager_id", "manager_name", "team_size", "total_exits", ratio("_ten", "_tenn", 1).alias("avg_tenure_at_exit_months"),
        rate.alias("attrition_rate"), "burnout_exits", ratio("burnout_exits", "total_exits", 4).alias("burnout_rate"),
        ratio("_ot", "_otn", 1).alias("avg_team_ot_hours"))
    return out.withColumn("team_health_flag", _cascade(F.col("attrition_rate"), flags, ">=", "Healthy")) \
        .orderBy(F.desc_nulls_last("attrition_rate"), "manager_id")


def hr_manager_scorecard_v1(emp: DataFrame, exits: DataFrame, att: DataFrame, reviews: DataFrame) -> DataFrame:
    """The first scorecard: every review and exit row of a team member is a
    row of the team (so counts and averages are per joined row). Each
    employee carries weight reviews x exits (at least 1 each) instead of
    being replicated."""
    rv = reviews.groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("_nr"), F.sum(to_dec("score")).alias("_rs"), F.count("score").alias("_rc"))
    xs = exits.groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("_nx"), F.sum("exit_survey_score").alias("_xs"), F.count("exit_survey_score").alias("_xc"))
    aa = hr_attendance_avg(att).select("employee_id", "avg_absence_rate", "avg_monthly_ot")
    e = (emp.filter(F.col("manager_id").isNotNull()).select("employee_id", "manager_id", "is_terminated")
         .join(rv, "employee_id", "left").join(xs, "employee_id", "left").join(aa, "employee_id", "left"))
    wr = F.greatest(F.coalesce("_nr", F.lit(0)), F.lit(1))
    wx = F.greatest(F.coalesce("_nx", F.lit(0)), F.lit(1))
    e = e.withColumn("_wr", wr).withColumn("_wx", wx).withColumn("_w", wr * wx)
    w = F.col("_w")
    ts = e.groupBy("manager_id").agg(
        F.sum(w).alias("team_size"), F.sum(F.col("is_terminated") * w).alias("total_terminations"),
        F.sum(to_dec("avg_absence_rate") * w).alias("_ab"), F.sum(F.when(F.col("avg_absence_rate").isNotNull(), w)).alias("_abn"),
        F.sum(to_dec("avg_monthly_ot") * w).alias("_ot"), F.sum(F.when(F.col("avg_monthly_ot").isNotNull(), w)).alias("_otn"),
        F.sum(F.col("_rs") * F.col("_wx")).alias("_rs"), F.sum(F.col("_rc") * F.col("_wx")).alias("_rc"),
        F.sum(F.col("_xs") * F.col("_wr")).alias("_xs"), F.sum(F.col("_xc") * F.col("_wr")).alias("_xc"))
    m = emp.select(F.col("employee_id").alias("_mid"), F.col("name").alias("manager_name"))
    j = ts.join(m, F.col("manager_id") == F.col("_mid"), "left")
    return j.select(
        "manager_id", "manager_name", "team_size", "total_terminations",
        ratio("total_terminations", "team_size", 4).alias("attrition_rate"),
        ratio("_ab", "_abn", 4).alias("team_avg_absence_rate"), ratio("_ot", "_otn", 1).alias("team_avg_monthly_ot"),
        ratio("_rs", "_rc", 2).alias("team_avg_review_score"), ratio("_xs", "_xc", 2).alias("team_avg_exit_survey"))


def _score_delta(reviews: DataFrame, delta: str) -> DataFrame:
    """Latest review score and its change. Only the last three reviews per
    employee matter (the delta uses the last two and their predecessors), so
    they are cut first: ROW_NUMBER <= 3 plans a partial WindowGroupLimit
    before the shuffle, and LAG then runs over at most three rows per key."""
    desc = Window.partitionBy("employee_id").orderBy(F.desc_nulls_last("review_date"), F.desc_nulls_last("review_period"))
    asc = Window.partitionBy("employee_id").orderBy(F.asc_nulls_first("review_date"), F.asc_nulls_first("review_period"))
    top3 = (reviews.select("employee_id", "score", "review_date", "review_period", F.row_number().over(desc).alias("rn"))
            .filter(F.col("rn") <= 3))
    rt = top3.select("employee_id", F.col("score").alias("latest_score"), F.lag("score").over(asc).alias("prev_score"), "rn")
    if delta == "max":
        # The reference: over the last two reviews, MAX(score) - MAX(COALESCE(previous, 0)).
        a = rt.filter(F.col("rn") <= 2).groupBy("employee_id").agg(
            F.max("latest_score").alias("_l"), F.max(F.coalesce("prev_score", F.lit(0.0))).alias("_p"))
        d = to_dec("_l") - to_dec("_p")
    elif delta == "latest":
        a = rt.filter(F.col("rn") == 1).select("employee_id", F.col("latest_score").alias("_l"), F.col("prev_score").alias("_p"))
        d = to_dec("_l") - to_dec("_p")
    else:
        raise ValueError(delta)
    return a.select("employee_id", F.col("_l").alias("current_review_score"), d.cast("double").alias("review_score_delta"))


def hr_flight_risk(emp: DataFrame, reviews: DataFrame, att: DataFrame, as_of: str | dt.date,
                   months: int = 6, delta: str = "max", how: str = "inner",
                   score_points=SCORE_DELTA_POINTS, overtime_points=OVERTIME_POINTS,
                   absence_points=ABSENCE_POINTS, labels=RISK_LABELS) -> DataFrame:
    """Points-based flight risk for active staff (score 0-100, label).
    ``how="left"`` keeps active staff without reviews or recent attendance
    (the reference's inner joins drop them); point tables are parameters."""
    sd = _score_delta(reviews, delta)
    since = F.add_months(F.lit(as_of).cast("date"), -months)
    ra = att.filter(F.col("month") >= since).groupBy("employee_id").agg(
        ratio(F.sum("overtime_hours"), F.count("overtime_hours"), 1).alias("recent_avg_ot"),
        ratio(F.sum(to_dec("absence_rate")), F.count("absence_rate"), 4).alias("recent_absence_rate"),
        ratio(F.sum("late_arrivals"), F.count("late_arrivals"), 1).alias("recent_late_avg"))
    base = (emp.filter(F.col("status") == "Active").join(sd, "employee_id", how).join(ra, "employee_id", how))
    tm = tenure_months()
    score_pts = _cascade(F.col("review_score_delta"), score_points, "<", 0)
    ot_pts = _cascade(F.col("recent_avg_ot"), overtime_points, ">=", 0)
    abs_pts = _cascade(F.col("recent_absence_rate"), absence_points, ">=", 0)
    ten_pts = (F.when(tm.between(12, 30), F.lit(TENURE_POINTS_IN_RANGE))
               .when(tm < 12, F.lit(TENURE_POINTS_SHORT)).otherwise(F.lit(TENURE_POINTS_LONG)))
    score = F.least(F.lit(100), score_pts + ot_pts + ten_pts + abs_pts)
    out = base.select(
        "employee_id", "name", "role", "department", "manager_id", tm.alias("tenure_months"),
        tenure_band("tenure_days").alias("tenure_band"), "hourly_rate", "current_review_score", "review_score_delta",
        "recent_avg_ot", "recent_absence_rate", "recent_late_avg", score.alias("flight_risk_score"))
    return out.withColumn("flight_risk_label", _cascade(F.col("flight_risk_score"), labels, ">=", "Low"))


def hr_flight_risk_v1(emp: DataFrame, reviews: DataFrame, att: DataFrame,
                      low_review: float = 3, high_absence: float = 0.10, high_ot: float = 20) -> DataFrame:
    """Three 0/1 signals and their count for staff not terminated."""
    j = (emp.filter(F.col("status") != "Terminated")
         .join(hr_latest_review(reviews).select("employee_id", "last_review_score"), "employee_id", "left")
         .join(hr_attendance_avg(att), "employee_id", "left"))
    f1 = F.when(F.col("last_review_score") < low_review, 1).otherwise(0)
    f2 = F.when(F.col("avg_absence_rate") > high_absence, 1).otherwise(0)
    f3 = F.when(F.col("avg_monthly_ot") > high_ot, 1).otherwise(0)
    return j.select("employee_id", "name", "role", "department", "manager_id", "tenure_days", "last_review_score",
                    "avg_absence_rate", "avg_monthly_ot", "avg_late_arrivals", f1.alias("low_review_flag"),
                    f2.alias("high_absence_flag"), f3.alias("high_ot_flag"), (f1 + f2 + f3).alias("risk_signal_count"))
