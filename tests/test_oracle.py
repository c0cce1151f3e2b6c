"""All registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

from check_queries import TABLES, normal
from farescope.catalog.base import load_all, oracle_text, run

SF = "/root/testdata/sf0.001"
TWINS = [name for name, q in load_all().items() if q.sql is not None]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", TWINS)
def test_matches_sql(spark, duck, name):
    df = run(spark, SF, name)
    cursor = duck.execute(oracle_text(load_all()[name]))
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), names)


def test_registry_is_complete():
    registry = load_all()
    assert len(registry) > 200
    assert sum(q.sql is None for q in registry.values()) < 10
