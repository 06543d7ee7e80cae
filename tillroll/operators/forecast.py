"""Seasonal forecast (N15): additive-trend, additive-season Holt-Winters
fitted per series, many series in parallel, in built-in functions only.

Spark builds each series at month grain, then one row per series holds its
values as an array (bounded by the calendar, never by the fact volume). The
recurrence is a fold over that array; a grid of smoothing parameters is a
literal array, folded for each entry, and the least sum of squared one-step
errors wins (the first among equals). Three rounds then halve the step
around the best triple. From there a compass search fits the parameters: it
tries a step up and down along each of them, moves to the best trial that is
better, halves the step where none is, and stops when the step is below
``TOLERANCE``; it is a fold over a state struct, bounded by ``ROUNDS``. No
UDF, so nothing has to reach Python workers, and an SQL engine can repeat
the same floating-point steps.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions.windows import fill_month_gaps

# Fixed values of the search: coarse grid, then steps around the best, bounds.
GRID = (0.1, 0.3, 0.5, 0.7, 0.9)
STEPS = (0.1, 0.05, 0.025)
BOUNDS = (0.01, 0.99)
TOLERANCE, ROUNDS = 1e-5, 80  # of the compass search
DIGITS = 6

FILLS = ("zero", "interpolate", "error")


def monthly_series(df: DataFrame, series_col: str, time_col: str, value_col: str, fill: str = "zero") -> DataFrame:
    """(series_id, period_month, value) with every month between a series'
    first and last month present. A month without a value counts as 0
    (``zero``, for sums), takes the line between its neighbours
    (``interpolate``, for rates; 0 where no neighbour has a value) or is
    refused (``error``)."""
    if fill not in FILLS:
        raise ValueError(f"fill must be one of {FILLS}")
    s = df.select(F.col(series_col).cast("string").alias("series_id"), F.trunc(F.col(time_col), "month").alias("period_month"),
                  F.col(value_col).alias("value")).filter(F.col("period_month").isNotNull())
    # decimals are summed exactly, then become doubles
    s = s.groupBy("series_id", "period_month").agg(F.sum("value").cast("double").alias("value"))
    s = fill_month_gaps(s, "period_month", ["series_id"])
    if fill == "zero":
        return s.fillna(0.0, subset=["value"])
    if fill == "error":
        return s.withColumn("value", F.coalesce("value", F.raise_error(F.concat(F.lit("no value for "), F.col("period_month").cast("string"))).cast("double")))
    w = Window.partitionBy("series_id").orderBy("period_month")
    at = F.when(F.col("value").isNotNull(), F.col("period_month"))
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    s = s.select("*", F.last("value", True).over(before).alias("_v0"), F.last(at, True).over(before).alias("_m0"),
                 F.first("value", True).over(after).alias("_v1"), F.first(at, True).over(after).alias("_m1"))
    steps = lambda a, b: ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("double")
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * steps(F.col("_m0"), F.col("period_month")) / steps(F.col("_m0"), F.col("_m1"))
    return s.select("series_id", "period_month", F.coalesce("value", line, "_v0", "_v1", F.lit(0.0)).alias("value"))


def _mean(values: Column, m: int) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.lit(float(m))


def _fold(y: Column, start: Column, a: Column, b: Column, g: Column, keep: bool) -> Column:
    """The recurrence over all values; the season's head belongs to the
    current month. ``keep``: also collect the one-step predictions."""
    def step(st, v):
        both, season = st["l"] + st["t"], st["s"][0]
        fitted, level = both + season, a * (v - season) + (1.0 - a) * both
        rest = F.slice(st["s"], 2, F.size(st["s"]))
        out = [level.alias("l"), (b * (level - st["l"]) + (1.0 - b) * st["t"]).alias("t"),
               F.concat(rest, F.array(g * (v - both) + (1.0 - g) * season)).alias("s"),
               (st["e"] + (fitted - v) * (fitted - v)).alias("e")]
        return F.struct(*out, F.concat(st["f"], F.array(fitted)).alias("f")) if keep else F.struct(*out)
    init = [start["l"].alias("l"), start["t"].alias("t"), start["s"].alias("s"), F.lit(0.0).alias("e")]
    if keep:
        init.append(F.array().cast("array<double>").alias("f"))
    return F.aggregate(y, F.struct(*init), step)


def _best(y: Column, start: Column, triples: Column) -> Column:
    """(e, p, a, b, g): least error, the first among equals."""
    def tried(p, i):
        return F.struct(_fold(y, start, p["a"], p["b"], p["g"], False)["e"].alias("e"), i.alias("p"),
                        p["a"].alias("a"), p["b"].alias("b"), p["g"].alias("g"))
    return F.array_min(F.transform(triples, tried))


def _literal(values) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(g).alias("g")) for a, b, g in itertools.product(values, repeat=3)])


def _around(best: Column, step: float) -> Column:
    return F.transform(_literal((-step, 0.0, step)), lambda d: F.struct(*[_inside(best[k] + d[k]).alias(k) for k in "abg"]))


def _inside(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(BOUNDS[0])), F.lit(BOUNDS[1]))


def _compass(y: Column, start: Column, best: Column, tolerance: float, rounds: int) -> Column:
    """(e, a, b, g, step) from the best triple on: never a larger error."""
    def trials(st):
        moved = []
        for k in "abg":
            for sign in (1.0, -1.0):
                moved.append(F.struct(*[(_inside(st[x] + F.lit(sign) * st["step"]) if x == k else st[x]).alias(x) for x in "abg"]))
        return F.array(*moved)

    def one(st, _):
        def after(t):
            better = t["e"] < st["e"]
            return F.struct(*[F.when(better, t[x]).otherwise(st[x]).alias(x) for x in "eabg"],
                            F.when(better, st["step"]).otherwise(st["step"] / 2.0).alias("step"))
        # a list of one binds the best trial, so that it is found once
        tried = F.transform(F.array(_best(y, start, trials(st))), after)[0]
        return F.when(st["step"] < tolerance, st).otherwise(tried)

    init = F.struct(*[best[x].alias(x) for x in "eabg"], F.lit(STEPS[-1]).alias("step"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), init, one)


def ts_holt_winters(df: DataFrame, series_col: str, time_col: str, value_col: str, m: int = 12, h: int = 6,
                    min_points: int = 24, fill: str = "zero", tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """Actual, fitted and ``h`` forecast rows per series (kind column), with
    the fitted smoothing parameters and the root mean squared error they
    reach, beside that of the search before (never smaller). A series shorter than two seasons (or ``min_points``) keeps its actual
    rows and has one more row of kind ``insufficient_history``."""
    s = monthly_series(df, series_col, time_col, value_col, fill)
    rows = s.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("period_month", "value"))).alias("r"))
    rows = rows.select("series_id", F.col("r.period_month").alias("at"), F.col("r.value").alias("y"))
    enough = F.size("y") >= max(min_points, 2 * m)
    first, second = _mean(F.slice("y", 1, m), m), _mean(F.slice("y", m + 1, m), m)
    fit = rows.filter(enough).withColumn("start", F.struct(
        first.alias("l"), ((second - first) / float(m)).alias("t"), F.transform(F.slice("y", 1, m), lambda v: v - first).alias("s")))
    y, start = F.col("y"), F.col("start")
    fit = fit.withColumn("best", _best(y, start, _literal(GRID)))
    for step in STEPS:
        fit = fit.withColumn("best", _best(y, start, _around(F.col("best"), step)))
    fit = fit.withColumn("search_sse", F.col("best.e")).withColumn("best", _compass(y, start, F.col("best"), tolerance, rounds))
    best = F.col("best")
    fit = fit.withColumn("end", _fold(y, start, best["a"], best["b"], best["g"], True))
    last = F.element_at("at", -1)
    ahead = F.transform(F.sequence(F.lit(1), F.lit(h)), lambda k: F.struct(
        F.add_months(last, k).alias("at"), F.lit("forecast").alias("kind"),
        (F.col("end.l") + k * F.col("end.t") + F.element_at(F.col("end.s"), (k - 1) % m + 1)).alias("value")))
    pairs = lambda values, kind: F.transform(F.arrays_zip(F.col("at").alias("at"), values.alias("v")), lambda z: F.struct(
        z["at"].alias("at"), F.lit(kind).alias("kind"), z["v"].alias("value")))
    names = ["series_id", "period_month", "kind", "value", "alpha", "beta", "gamma", "rmse", "search_rmse"]
    fitted = fit.select("series_id", F.explode(F.concat(pairs(y, "actual"), pairs(F.col("end.f"), "fitted"), ahead)).alias("x"), "best", "search_sse", F.size("y").alias("n"))
    fitted = fitted.select("series_id", "x.at", "x.kind", F.round("x.value", DIGITS), *[F.round(best[k], DIGITS) for k in "abg"], F.round(F.sqrt(best["e"] / F.col("n")), DIGITS),
                           F.round(F.sqrt(F.col("search_sse") / F.col("n")), DIGITS))
    none = F.lit(None).cast("double")
    short = rows.filter(~enough).select("series_id", F.explode(F.concat(pairs(y, "actual"), F.array(F.struct(
        last.alias("at"), F.lit("insufficient_history").alias("kind"), none.alias("value"))))).alias("x"))
    short = short.select("series_id", "x.at", "x.kind", F.round("x.value", DIGITS), *[none] * 5)
    return fitted.toDF(*names).unionByName(short.toDF(*names))
