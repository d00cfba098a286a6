from pathlib import Path

import duckdb
import pytest

from loomcast.plans import catalogue, problems
from tools.compare import TABLES, canonical

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
QUERIES, SQL = {**problems.QUERIES, **catalogue.QUERIES}, {**problems.SQL, **catalogue.SQL}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p2_event_cells", "p3_found", "p4_found", "p5_found", "p5_clean", "road_intensity", "poi_features", "mean_field_forecast", "event_quality_flags", "observed_loglik_compare"])
def test_query_equals_its_sql(spark, con, name):
    got, want = canonical(QUERIES[name](spark, DATA).toPandas()), canonical(con.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert not [n for n, s in SQL.items() if "LIMIT" in s.upper().split()]
