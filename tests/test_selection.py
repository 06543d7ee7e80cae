"""Exact top-k selection by digit histograms, and the Pareto report on it."""

import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tillroll.functions import selection
from tillroll.operators import guests

KINDS = {"long": lambda r: r.choice([r.randrange(-5, 5), r.randrange(-10**18, 10**18), -2**63, 2**63 - 1]),
         "decimal(18,2)": lambda r: D(r.choice([r.randrange(-300, 300), r.randrange(-10**17, 10**17)])) / 100,
         "int": lambda r: r.randrange(-3, 3)}


def _rows(kind, n, seed):
    r = random.Random(seed)
    return [(i, None if r.random() < 0.1 else KINDS[kind](r)) for i in r.sample(range(10 * n), n)]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("share", [0.0, 0.2, 0.35, 1.0])
def test_split_top_equals_a_sort(spark, kind, share):
    rows = _rows(kind, 180, 7)
    df = spark.createDataFrame(rows, f"id long, v {kind}").repartition(4)
    k = int(D(len(rows) * D(str(share))).to_integral_value("ROUND_HALF_UP"))
    ordered = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    got = {r.id for r in selection.split_top(df, "v", "id", share).filter("in_top").collect()}
    assert got == {i for i, _ in ordered[:k]}


def test_all_rows_tied_and_string_ids(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(5).alias("v"))
    assert selection.split_top(df, "v", "id", 0.2).filter("in_top").count() == 200
    assert selection.split_top(df.limit(0), "v", "id", 0.2).count() == 0
    with pytest.raises(TypeError):
        selection.order_code(df.selectExpr("1.5D AS v"), "v")


def _people(spark, values):
    return spark.createDataFrame([(f"G{i}", None if v is None else D(v)) for i, v in enumerate(values)], "guest_id string, lifetime_value decimal(18,2)")


@pytest.mark.parametrize("values", [["10", "10", "10", "10", "10"], ["7", "-3", "0.01", None, "7"], [None, None, None], ["5"], [],
                                    ["9", "8", "7", None, None, None, None, None, None, None], [str(i) for i in range(23)]])
def test_pareto_on_edges(spark, values):
    known = sorted((D(v) for v in values if v is not None), reverse=True)
    line = known + [None] * (len(values) - len(known))
    k = int((D(len(line)) * D("0.2")).to_integral_value("ROUND_HALF_UP"))
    want = {}
    for name, part in (("Top 20% of guests", line[:k]), ("Bottom 80% of guests", line[k:])):
        if part:
            some = [x for x in part if x is not None]
            want[name] = (len(part), float(sum(some)) if some else None)
    got = {r.segment: (r.guests, r.revenue) for r in guests.guest_pareto(_people(spark, values)).collect()}
    assert got == want


def test_building_starts_no_job_and_sorts_nothing(spark):
    sc = spark.sparkContext
    df = _people(spark, [str(i * 3 % 97) for i in range(200)])
    sc.setJobGroup("pareto-build", "building only")
    try:
        out = guests.guest_pareto(df)
        assert out.columns and not list(sc.statusTracker().getJobIdsForGroup("pareto-build"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD checkpoint" not in plan
    assert "NestedLoopJoin" not in plan
