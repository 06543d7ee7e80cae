"""HR report tables (N1-N14): the notebook's chart data sets as DataFrames.

They read the marts lazily; nothing is pulled to the driver, and every
ranking or window runs over rows that are already aggregated (roles,
bands, months, managers) or over a bounded score histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.banding import band_labels
from tillroll.functions.calendar import month_label
from tillroll.functions.numeric import fix, ratio, to_dec
from tillroll.functions.quantiles import histogram
from tillroll.functions.reindex import reindex
from tillroll.functions.windows import rolling_mean

# Flight-risk label order used by the report.
RISK_LEVELS = ["High", "Medium", "Low"]


def _exited(att_mart: DataFrame) -> DataFrame:
    return att_mart.filter((F.col("is_terminated") == 1) & F.col("exit_reason").isNotNull())


def hr_headline_kpis(att_mart: DataFrame) -> DataFrame:
    term = F.col("is_terminated") == 1
    a = att_mart.agg(
        F.count(F.lit(1)).alias("total"), F.sum("is_terminated").alias("terminated"),
        F.count_if(F.col("exit_category") == "Voluntary").alias("voluntary"),
        F.sum(F.when(term, to_dec("tenure_months", 1))).alias("_t"), F.count(F.when(term, F.col("tenure_months"))).alias("_tn"),
        F.count_if(F.col("eligible_for_rehire") == "Yes").alias("rehire_yes"))
    return a.select("total", (F.col("total") - F.col("terminated")).alias("active"), "terminated",
                    ratio("terminated", "total", 1, 100).alias("overall_rate"), "voluntary",
                    ratio("voluntary", "terminated", 1, 100).alias("voluntary_pct"),
                    ratio("_t", "_tn", 1).alias("avg_tenure"), "rehire_yes")


def _rate_by(att_mart: DataFrame, key: str) -> DataFrame:
    a = att_mart.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.sum("is_terminated").alias("exits"))
    return a.withColumn("attrition_rate", ratio("exits", "total", 1, 100))


def hr_rate_by_role(att_mart: DataFrame, flag_pct: int = 50) -> DataFrame:
    a = _rate_by(att_mart, "role")
    return a.withColumn("high_attrition", F.col("exits") * 100 >= F.col("total") * flag_pct) \
        .orderBy("attrition_rate", "role")


def hr_rate_by_tenure(att_mart: DataFrame) -> DataFrame:
    """All six bands in order; a band without staff keeps NULL measures."""
    return reindex(_rate_by(att_mart, "tenure_band"), "tenure_band", band_labels(), "band_order")


def hr_exit_reasons(att_mart: DataFrame) -> DataFrame:
    return _exited(att_mart).groupBy("exit_reason").agg(F.count(F.lit(1)).alias("exits")) \
        .orderBy(F.desc("exits"), "exit_reason")


def exit_reasons(att_mart: DataFrame) -> list[str]:
    """The distinct exit reasons, in order (runs a job; a handful of values)."""
    return sorted(r[0] for r in _exited(att_mart).select("exit_reason").distinct().collect())


def hr_reason_by_role(att_mart: DataFrame, reasons: list[str]) -> DataFrame:
    """Role x exit reason counts, zero filled, a column per given reason
    (``exit_reasons`` finds those of a written mart)."""
    return _exited(att_mart).groupBy("role").agg(
        *[F.count_if(F.col("exit_reason") == r).alias(r) for r in reasons]).orderBy("role")


def hr_rolling_rate(trend: DataFrame, n: int = 3, series: list[str] | None = None) -> DataFrame:
    """Trailing n-month mean of the attrition rate (min 1 month)."""
    s, c = rolling_mean(to_dec("monthly_attrition_rate"), "period_month", n, series)
    return trend.withColumn("rolling_rate", ratio(s, c, 6))


def hr_seasonality(trend: DataFrame) -> DataFrame:
    a = trend.groupBy("month_num").agg(
        F.sum("exits_count").alias("_x"), F.count("exits_count").alias("_xn"),
        F.sum(to_dec("monthly_attrition_rate")).alias("_r"), F.count("monthly_attrition_rate").alias("_rn"))
    return a.select("month_num", ratio("_x", "_xn", 2).alias("avg_exits"), ratio("_r", "_rn", 4).alias("avg_rate"),
                    month_label("month_num").alias("month_label")).orderBy("month_num")


def hr_season_spikes(trend: DataFrame, months=(1, 2), threshold: int = 3) -> DataFrame:
    return trend.filter(F.col("month_num").isin(list(months)) & (F.col("exits_count") > threshold)) \
        .select("period_month", "year", "month_num", "exits_count").orderBy("period_month")


def hr_worst_managers(scorecard: DataFrame, k: int = 3) -> DataFrame:
    return scorecard.select(
        "manager_id", "manager_name", "team_size", "total_exits", "attrition_rate",
        fix(F.col("attrition_rate") * F.lit(100.0), 2).alias("attrition_pct"), "burnout_rate", "team_health_flag",
    ).orderBy(F.desc_nulls_last("attrition_rate"), "manager_id").limit(k)


def hr_ot_burnout(scorecard: DataFrame) -> DataFrame:
    return scorecard.select(
        "manager_id", F.split(F.col("manager_name"), " ").getItem(0).alias("first_name"), "avg_team_ot_hours",
        fix(F.col("burnout_rate") * F.lit(100.0), 2).alias("burnout_pct"))


def hr_ot_burnout_corr(scorecard: DataFrame) -> DataFrame:
    """Pearson correlation over the managers that have both figures; NULL
    where either is the same for all of them (F.corr divides by zero there)."""
    both = F.col("avg_team_ot_hours").isNotNull() & F.col("burnout_rate").isNotNull()
    x, y = (F.when(both, F.col(c)) for c in ("avg_team_ot_hours", "burnout_rate"))
    corr = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return scorecard.agg(F.count("burnout_rate").alias("managers"), fix(corr, 6).alias("ot_burnout_corr"))


def hr_risk_levels(risk: DataFrame) -> DataFrame:
    a = risk.groupBy("flight_risk_label").agg(F.count(F.lit(1)).alias("employees"))
    return reindex(a, "flight_risk_label", RISK_LEVELS, "level_order")


def hr_risk_distribution(risk: DataFrame, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers per role from the score histogram (scores are
    integers 0-100, so a role is at most 101 histogram rows): one aggregate
    reads the quartiles off the counts and keeps the histogram as an array,
    from which whiskers and outliers are folded."""
    v = F.col("flight_risk_score")
    g = histogram(risk, ["role"], "flight_risk_score").groupBy("role").agg(
        F.sum("_cnt").alias("employees"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_cnt")).alias("_q"),
        F.collect_list(F.struct(v.alias("v"), F.col("_cnt").alias("n"))).alias("_h"))
    g = g.select("role", "employees", "_h", *[F.col("_q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    near = lambda x: x["v"].between(F.col("q1") - reach, F.col("q3") + reach)
    inside = F.transform(F.filter("_h", near), lambda x: x["v"])
    out = F.aggregate(F.filter("_h", lambda x: ~near(x)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return g.select("role", "employees", F.array_min(inside).alias("whisker_low"), "q1", "median", "q3",
                    F.array_max(inside).alias("whisker_high"), out.alias("n_outliers")).orderBy("role")


def hr_top_risk(risk: DataFrame, k: int = 10) -> DataFrame:
    return risk.select("employee_id", "name", "role", "tenure_months", "current_review_score", "recent_avg_ot",
                       "flight_risk_score", "flight_risk_label") \
        .orderBy(F.desc("flight_risk_score"), "employee_id").limit(k)


def hr_key_findings(att_mart: DataFrame, scorecard: DataFrame, risk: DataFrame) -> DataFrame:
    """One row of headline findings from three one-row aggregates, each
    computed once in one plan: both modes (exit reason, tenure band of
    leavers) from a GROUPING SETS pass over the attrition mart, picked with
    MIN_BY over (-count, label) so ties go to the first label; the worst
    manager as a MIN_BY over the scorecard; the risk counts. The three rows
    are unioned and folded by one final aggregate (no join, no subquery)."""
    ex = att_mart.filter(F.col("is_terminated") == 1)
    g = ex.groupingSets([["exit_reason"], ["tenure_band"]], "exit_reason", "tenure_band").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"))
    reason_row = (F.col("_gid") == 1) & F.col("exit_reason").isNotNull()
    band_row = F.col("_gid") == 2
    modes = g.agg(
        F.min_by(F.struct("exit_reason", "n"), F.when(reason_row, F.struct(-F.col("n"), F.col("exit_reason")))).alias("_r"),
        F.min_by(F.struct("tenure_band", "n"), F.when(band_row, F.struct(-F.col("n"), F.col("tenure_band")))).alias("_b"))
    rate = F.col("attrition_rate")
    worst = scorecard.agg(F.min_by(
        F.struct("manager_name", fix(rate * F.lit(100.0), 2).alias("pct")),
        F.struct(rate.isNull(), -rate, F.col("manager_id"))).alias("_w"))
    lab = F.col("flight_risk_label")
    counts = risk.agg(F.count_if(lab == "High").alias("high_risk_count"),
                      F.count_if(lab == "Medium").alias("medium_risk_count"),
                      F.count_if(lab == "Low").alias("low_risk_count"))
    u = modes.unionByName(worst, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True)
    one = u.agg(*[F.max(c).alias(c) for c in ("_r", "_b", "_w", "high_risk_count", "medium_risk_count", "low_risk_count")])
    return one.select(
        F.col("_r.exit_reason").alias("top_exit_reason"), F.col("_r.n").alias("top_exit_reason_count"),
        F.col("_b.tenure_band").alias("peak_tenure_band"), F.col("_b.n").alias("peak_tenure_band_exits"),
        F.col("_w.manager_name").alias("worst_manager_name"), F.col("_w.pct").alias("worst_manager_attrition_pct"),
        "high_risk_count", "medium_risk_count", "low_risk_count")
