"""Plan-shape guards for the scale properties (checked on executed plans)."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tillroll.functions.ranking import global_row_number, latest_by


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_nested_loop_or_cartesian_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert not re.search(r"BroadcastNestedLoopJoin|CartesianProduct", plan)


def test_latest_by_limits_before_the_shuffle(spark):
    df = spark.range(20000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    plan = _plan(latest_by(df, ["k"], [F.desc("t")]))
    # partial limit below the exchange, final limit above it
    assert plan.count("WindowGroupLimit") >= 2
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_global_rank_range_partitions_the_data(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("v"))
    ranked = global_row_number(df, [F.desc("v"), F.asc("id")], "rn", num_partitions=5)
    plan = _plan(ranked)
    # the rows are read back from the checkpoint written after a range exchange;
    # the only single-partition step is the offsets window over per-partition counts
    for line in plan.splitlines():
        if "SinglePartition" in line:
            assert "_pid" in plan[plan.index(line):plan.index(line) + 2000]
    assert sorted(r.rn for r in ranked.collect()) == list(range(1, 5001))


def test_hot_key_is_combined_map_side(spark):
    # one key holds a third of the rows; the plan must aggregate before the exchange
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
                                   F.lit(1).alias("v"))
    plan = _plan(df.groupBy("k").agg(F.sum("v")))
    assert re.search(r"HashAggregate\(keys=\[k#\d+L?\], functions=\[partial_sum", plan)


def test_flight_risk_cuts_reviews_before_lag(spark):
    plan = _plan(E.queries()["hr_flight_risk"](spark, SF_SMALL))
    assert plan.count("WindowGroupLimit") >= 2
