"""Layers as catalog views, CSV landing with planted faults, build-once marts."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_working import same
from tillroll.operators import hr_marts, hr_staging
from tillroll.plans import catalog, hr_queries, landing_queries
from tillroll.plans.mart_store import MartStore, snapshot
from tillroll.sources import io, schemas
from tillroll.sources.testdata import AS_OF, TestTables


@pytest.fixture(scope="module")
def layers(spark):
    prefix, names = landing_queries.layers(spark, SF_SMALL)
    yield names
    catalog.drop_layers(spark, prefix)


def staged(spark):
    return hr_queries.hr_inputs(spark, SF_SMALL)


def test_views_equal_the_operators_in_another_session(spark, layers):
    emp, ex, att, rv = staged(spark)
    want = {"stg_employees": emp, "stg_exit_records": ex, "stg_attendance_monthly": att, "stg_performance_reviews": rv,
            "mart_employee_attrition": hr_marts.hr_employee_attrition(emp, ex, rv, att), "mart_monthly_attrition_trend": hr_marts.hr_monthly_trend(att, ex),
            "mart_manager_scorecard": hr_marts.hr_manager_scorecard(emp, ex, att), "mart_flight_risk_signals": hr_marts.hr_flight_risk(emp, rv, att, AS_OF)}
    assert set(want) == set(catalog.VIEWS)
    other = spark.newSession()
    for name, df in want.items():
        got = other.table(layers[name])
        assert same(got, df), name
        assert dict(got.dtypes) == dict(df.dtypes), name


def test_views_are_lazy_and_placed_where_told(spark, tmp_path):
    prefix = "lazy_"
    names = catalog.create_layers(spark, str(tmp_path), "2024-06-30", prefix)
    try:
        assert spark.table(names["stg_employees"]).count() == 0
        row = (7, " Ann ", "Mover", "Ops", "2024-01-01", None, None, 20.0, "3.0", "Active")
        spark.createDataFrame([row, (8, "Bo", None, None, "not a date", "2024-02-01", "x", None, "odd", None)], schemas.RAW_EMPLOYEES).write.insertInto(names["employees"])
        got = {r.employee_id: r for r in spark.newSession().table(names["stg_employees"]).collect()}
        assert (got[7].name, got[7].manager_id, got[7].tenure_days, got[7].is_terminated) == ("Ann", 3, 181, 0)
        assert got[8].hire_date is None and got[8].tenure_days is None and got[8].manager_id is None and got[8].is_terminated == 0
        place = spark.sql(f"DESCRIBE DATABASE {prefix}raw").filter("info_name = 'Location'").first()["info_value"]
        assert str(tmp_path) in place
        again = catalog.create_layers(spark, str(tmp_path), "2024-07-31", prefix)  # views replaced, rows kept
        assert spark.table(again["stg_employees"]).filter("employee_id = 7").first().tenure_days == 212
    finally:
        catalog.drop_layers(spark, prefix)


def test_views_are_created_in_order_of_need():
    for name, view in catalog.VIEWS.items():
        assert all(n in catalog.VIEWS or n in catalog.RAW for n in view.needs), name
        assert all("{" + n + "}" in view.sql for n in view.needs), name


def test_staging_takes_text_landings(spark):
    """The same staging rows from typed and from all-string landings."""
    t = TestTables(spark, SF_SMALL)
    for raw, stage in ((t.employees_raw(), lambda r: hr_staging.stg_employees(r, AS_OF)), (t.exits_raw(), hr_staging.stg_exits),
                       (t.attendance_raw(), hr_staging.stg_attendance), (t.reviews_raw(), hr_staging.stg_reviews)):
        text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
        assert all(f.dataType.simpleString() == "string" for f in schemas.as_strings(raw.schema).fields)
        assert same(stage(text), stage(raw))


def test_export_reads_back_row_by_row(spark):
    path = landing_queries.write_employee_export(spark, SF_SMALL, files=3)
    df = io.read_csv(spark, path, schemas.RAW_EMPLOYEES)
    assert df.columns == [*landing_queries.HEADER, io.CORRUPT]  # not the folder's partition column
    counts = io.landing_counts(df).first()
    ids = [r.employee_id for r in TestTables(spark, SF_SMALL).employees_raw().select("employee_id").collect()]
    bad = [i for i in ids if not i % 19 or not i % 17 or not i % 13]
    assert (counts.rows, counts.corrupt_rows) == (len(ids), len(bad))
    names = {r.name for r in df.filter(F.col(io.CORRUPT).isNull()).collect()}
    assert any(n.startswith('Müller, "Bo" Customer') for n in names) and not any("\r" in n for n in names)


def test_a_mart_is_built_once_and_again_for_other_inputs(spark, tmp_path):
    inputs = str(tmp_path / "in")
    spark.range(3).write.parquet(inputs)
    store, calls = MartStore(spark, [inputs], str(tmp_path / "store")), []

    def build():
        calls.append(1)
        return spark.read.parquet(inputs).agg(F.count("*").alias("n"))
    assert [store.get("m", build, as_of="a").first().n for _ in range(3)] == [3, 3, 3] and len(calls) == 1
    store.get("m", build, as_of="b")
    assert len(calls) == 2  # other parameters
    before = snapshot(spark, [inputs])
    spark.range(4).write.mode("append").parquet(inputs)
    assert snapshot(spark, [inputs]) != before
    assert store.get("m", build, as_of="a").first().n == 7 and len(calls) == 3


def test_a_failed_build_leaves_nothing(spark, tmp_path):
    inputs = str(tmp_path / "in")
    spark.range(3).write.parquet(inputs)
    store = MartStore(spark, [inputs], str(tmp_path / "store"))
    with pytest.raises(Exception, match="lost"):
        store.get("m", lambda: spark.range(1).select(F.raise_error(F.lit("lost")).alias("n")))
    assert store.get("m", lambda: spark.range(2).toDF("n")).count() == 2


def test_key_findings_read_the_marts_only(spark):
    df = hr_queries.q_hr_key_findings(spark, SF_SMALL)
    assert len(df.collect()) == 1
    assert not any("orders" in f or "customer" in f for f in df.inputFiles())
