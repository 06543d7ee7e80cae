"""Source queries (S1, S3, S4, S6) over the test data: CSV exports with
planted faults landed typed and as text, and the layers as catalog views.
Each oracle builds its rows from the tables by the same fault rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll.operators import hr_staging
from tillroll.plans import catalog
from tillroll.plans.hr_queries import ATTRITION_SQL, RISK_SQL, SCORECARD_SQL, STG, TREND_SQL
from tillroll.plans.registry import register
from tillroll.plans.views import STAGING, with_views
from tillroll.session import shared_dir
from tillroll.sources import io, schemas
from tillroll.sources.testdata import AS_OF, TestTables

HEADER = [f.name for f in schemas.RAW_EMPLOYEES.fields]
SHORT, LONG, NO_NUMBER, QUOTED = 19, 17, 13, 11  # every so many ids carry the fault


def write_employee_export(spark, d: str, files: int = 4) -> str:
    """The employee table as CSV files with a header each, CRLF line ends,
    quoted UTF-8 names, and rows with too few or too many fields or an id
    that is no number."""
    t = TestTables(spark, d).employees_raw()
    i = F.col("employee_id")
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in HEADER}
    text["employee_id"] = F.concat(F.when(i % NO_NUMBER == 0, "x").otherwise(""), text["employee_id"])
    text["name"] = F.when(i % QUOTED == 0, F.concat(F.lit('"Müller, ""Bo"" '), text["name"], F.lit('"'))).otherwise(text["name"])
    line = F.when(i % SHORT == 0, F.concat_ws(",", *[text[c] for c in HEADER[:4]])).otherwise(
        F.concat(F.concat_ws(",", *text.values()), F.when(i % LONG == 0, ",extra").otherwise("")))
    lines = t.select(F.pmod(F.xxhash64("employee_id"), F.lit(files)).alias("file"), F.lit(1).alias("below"), line.alias("line"))
    heads = spark.range(files).select(F.col("id").alias("file"), F.lit(0).alias("below"), F.lit(",".join(HEADER)).alias("line"))
    path = shared_dir(spark, f"export-{uuid.uuid4().hex}")
    (lines.unionByName(heads).repartition(files, "file").sortWithinPartitions("file", "below", "line").select("file", "line")
     .write.partitionBy("file").option("lineSep", "\r\n").text(path))
    return path


# the export's rows: how each reads back, and its text
_EXPORT = f"""export AS (
  SELECT *, id % {SHORT} = 0 AS short, id % {LONG} = 0 AND id % {SHORT} <> 0 AS long, id % {NO_NUMBER} = 0 AS odd,
    CASE WHEN id % {QUOTED} = 0 THEN 'Müller, "Bo" ' || name ELSE name END AS read_name
  FROM (SELECT *, employee_id AS id FROM employees)),
written AS (
  SELECT *, list_transform([(CASE WHEN odd THEN 'x' ELSE '' END) || id, CASE WHEN id % {QUOTED} = 0 THEN '"' || replace(read_name, '"', '""') || '"' ELSE name END, role,
      department, hire_date, termination_date, termination_type, CAST(hourly_rate AS VARCHAR), manager_id, status], lambda x: coalesce(x, '')) AS f
  FROM export)"""


def _export_sql(body: str) -> str:
    return with_views(f"WITH {_EXPORT}\n{body}", "employees")


@register("src_csv_landing", _export_sql("""
SELECT employee_id, read_name AS name, role, department, hire_date, termination_date, termination_type, CAST(hourly_rate AS DOUBLE) AS hourly_rate, manager_id, status
FROM export WHERE NOT (short OR long OR odd)"""))
def q_src_csv_landing(spark, d):
    """Rows that parsed, typed by the declared schema."""
    df = io.read_csv(spark, write_employee_export(spark, d), schemas.RAW_EMPLOYEES)
    return df.filter(F.col(io.CORRUPT).isNull()).select(*HEADER)


@register("src_csv_quarantine", _export_sql("""
SELECT CASE WHEN short THEN array_to_string(f[:4], ',') WHEN long THEN array_to_string(f, ',') || ',extra' ELSE array_to_string(f, ',') END AS line
FROM written WHERE short OR long OR odd"""))
def q_src_csv_quarantine(spark, d):
    """Rows that did not parse, as delivered, out of the written quarantine."""
    path = shared_dir(spark, f"quarantine-{uuid.uuid4().hex}")
    io.write_mart(io.corrupt_rows(io.read_csv(spark, write_employee_export(spark, d), schemas.RAW_EMPLOYEES)), path)
    return io.read_mart(spark, path).select(F.col(io.CORRUPT).alias("line"))


@register("src_landing_counts", _export_sql("""
SELECT count(*) AS rows, count(*) FILTER (WHERE short OR long OR odd) AS corrupt_rows, count(*) FILTER (WHERE odd) AS null_employee_id,
  0 + count(*) FILTER (WHERE read_name IS NULL) AS null_name, count(*) FILTER (WHERE role IS NULL) AS null_role, count(*) FILTER (WHERE department IS NULL) AS null_department,
  """ + ", ".join(f"count(*) FILTER (WHERE short OR {c} IS NULL) AS null_{c}" for c in HEADER[4:]) + " FROM export"))
def q_src_landing_counts(spark, d):
    """The landing check: a row that did not parse keeps the fields that could be read."""
    return io.landing_counts(io.read_csv(spark, write_employee_export(spark, d), schemas.RAW_EMPLOYEES))


@register("src_string_landing", _export_sql(f"""
, delivered AS (SELECT CASE WHEN NOT odd THEN id END AS employee_id, read_name AS name, role, department, hire_date, termination_date, termination_type, hourly_rate,
    manager_id, status FROM export WHERE NOT (short OR long))
{STAGING['stg_employees'][1].replace('FROM employees', 'FROM delivered')}""".replace("\n, delivered", ", delivered", 1)))
def q_src_string_landing(spark, d):
    """Landed as text throughout, typed by the staging layer."""
    df = io.read_csv(spark, write_employee_export(spark, d), schemas.as_strings(schemas.RAW_EMPLOYEES))
    return hr_staging.stg_employees(df.filter(F.col(io.CORRUPT).isNull()).select(*HEADER), AS_OF)


# ------------------------------------------------------------------ catalog
def layers(spark, d: str) -> tuple[str, dict[str, str]]:
    """Raw tables of the test data and the views over them, in schemas of
    their own; returns the prefix and the full names."""
    prefix = f"t{uuid.uuid4().hex[:12]}_"
    names = catalog.create_layers(spark, shared_dir(spark, f"catalog-{prefix[:-1]}"), AS_OF, prefix)
    t = TestTables(spark, d)
    for name, df in {"employees": t.employees_raw(), "exit_records": t.exits_raw(), "attendance_monthly": t.attendance_raw(),
                     "performance_reviews": t.reviews_raw()}.items():
        schema = catalog.RAW[name]
        df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.insertInto(names[name])
    return prefix, names


def _view_query(name):
    def run(spark, d):
        _, names = layers(spark, d)
        return spark.newSession().table(names[name])  # another session of the catalog
    return run


for _name, _sql in (("mart_employee_attrition", ATTRITION_SQL), ("mart_monthly_attrition_trend", TREND_SQL), ("mart_manager_scorecard", SCORECARD_SQL),
                    ("mart_flight_risk_signals", RISK_SQL), ("stg_exit_records", "SELECT * FROM stg_exits"), ("stg_performance_reviews", "SELECT * FROM stg_reviews")):
    register(f"src_view_{_name}", with_views(_sql, *STG))(_view_query(_name))
