import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

TINY = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TINY), reason="no test data")


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["target_id", "confidence", "path_count", "via_part", "c1", "c2", "weakest_step"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(v):
    if hasattr(v, "isoformat"):
        return str(v)[:26].replace("+00:00", "")
    return round(float(v), 6) if type(v).__name__ in ("Decimal", "float") else v


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql()))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(TINY):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{TINY}/{f}'")
    df = entry.queries()[name](spark, TINY)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(_plain(v) for v in r) for r in result.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want
