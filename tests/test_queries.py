"""Every registered query beside its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

from terraspan.plans import registry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import TABLES, rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql := registry.ORACLE_SQL.get(name):
        found = db.execute(sql)
        assert got == rows([c[0] for c in found.description], found.fetchall())
