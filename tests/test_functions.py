"""Shared expressions: rounding recipe, calendar, bands, ranking, quantiles."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.banding import tenure_band
from tillroll.functions.calendar import day_type, iso_weekday, week_number, weekday_name
from tillroll.functions.numeric import money, ratio
from tillroll.functions.quantiles import histogram, quantiles_from_histogram
from tillroll.functions.ranking import global_row_number, latest_by
from tillroll.functions.reindex import reindex


def test_ratio_zero_and_null_divisor(spark):
    df = spark.createDataFrame([(1, 0), (1, None), (1, 3)], "a int, b int")
    got = [r[0] for r in df.select(ratio("a", "b", 2, 100)).collect()]
    assert got == [None, None, 33.33]


def test_money_rounds_half_up_in_decimal(spark):
    df = spark.createDataFrame([("1.005",), ("-2.345",)], "x string").select(F.col("x").cast("decimal(18,4)").alias("x"))
    assert [r[0] for r in df.select(money("x")).collect()] == [1.01, -2.35]


def test_week_number_matches_strftime_W(spark):
    days = [dt.date(1995, 1, 1) + dt.timedelta(days=i) for i in range(0, 365 * 8, 3)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = [(r[0], r[1]) for r in df.select("d", week_number("d")).collect()]
    assert all(w == d.strftime("%W") for d, w in got)


def test_weekday_and_day_type(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(7)], "d date")
    rows = df.select("d", weekday_name("d"), iso_weekday("d"), day_type("d")).collect()
    for d, name, iso, typ in rows:
        assert name == d.strftime("%A") and iso == d.isoweekday()
        assert typ == ("Weekend/Friday" if d.isoweekday() in (5, 6, 7) else "Weekday")


def test_tenure_band_edges(spark):
    edges = {89: "0-3 months", 90: "3-6 months", 179: "3-6 months", 180: "6-12 months", 364: "6-12 months",
             365: "1-2 years", 729: "1-2 years", 730: "2-3 years", 1094: "2-3 years", 1095: "3+ years", None: "3+ years"}
    df = spark.createDataFrame([(k,) for k in edges], "d int")
    got = {r[0]: r[1] for r in df.select("d", tenure_band("d")).collect()}
    assert got == edges


def test_global_row_number_equals_row_number(spark):
    random.seed(7)
    data = [(i, float(random.choice([1, 2, 3, 5, 8, 8, 8]) if i % 3 else random.random())) for i in range(3000)]
    df = spark.createDataFrame(data, "id long, v double")
    order = [F.desc("v"), F.asc("id")]
    got = {r.id: r.rn for r in global_row_number(df, order, "rn", num_partitions=7).collect()}
    exp = {r.id: r.rn for r in df.withColumn("rn", F.row_number().over(Window.orderBy(*order))).collect()}
    assert got == exp


def test_latest_by_takes_first_in_order(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 5, "z")], "k int, t int, v string")
    got = {r.k: r.v for r in latest_by(df, ["k"], [F.desc("t")]).collect()}
    assert got == {1: "c", 2: "z"}


def test_histogram_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(g, int(v)) for g in "abc" for v in rng.integers(0, 101, size=int(rng.integers(1, 60)))]
    df = spark.createDataFrame(rows, "g string, v int")
    q = quantiles_from_histogram(histogram(df, ["g"], "v"), ["g"], "v", {"q1": .25, "med": .5, "q3": .75})
    for r in q.collect():
        vals = np.array([v for g, v in rows if g == r.g])
        assert r.n == len(vals)
        for name, p in (("q1", 25), ("med", 50), ("q3", 75)):
            assert abs(r[name] - np.percentile(vals, p)) < 1e-9


def test_reindex_keeps_missing_labels(spark):
    df = spark.createDataFrame([("Low", 3)], "label string, n long")
    rows = reindex(df, "label", ["High", "Medium", "Low"], "pos").collect()
    assert [(r.label, r.pos, r.n) for r in rows] == [("High", 1, None), ("Medium", 2, None), ("Low", 3, 3)]


def test_bands_schema_is_string(spark):
    df = spark.createDataFrame([(1,)], T.StructType([T.StructField("d", T.IntegerType())]))
    assert dict(df.select(tenure_band("d").alias("b")).dtypes)["b"] == "string"
