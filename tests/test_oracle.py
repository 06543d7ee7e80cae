"""Every registered query against its SQL twin in DuckDB (sf0.001)."""

import pytest

import __spark_entry__ as E
from tillroll.plans import registry
from tests.conftest import SF_SMALL
from tools.oracle_check import duck, kind_duck, kind_spark, rows_of

registry.load_all()
ORACLE = registry.ORACLE
QUERIES = registry.QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srec = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    drec = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    skinds = {f.name: kind_spark(f.dataType) for f in sdf.schema.fields}
    dkinds = {d[0]: kind_duck(d[1]) for d in res.description}
    assert skinds == dkinds
    assert rows_of(sdf.columns, srec) == rows_of(dcols, drec)


def test_every_query_has_oracle_or_is_documented():
    no_sql = set(QUERIES) - set(ORACLE)
    assert no_sql == set()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "gross_revenue" in df.columns
