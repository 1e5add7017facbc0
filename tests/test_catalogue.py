"""Every query of the catalogue against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from postmill.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted(str([r[c] for c in columns]) for r in df.collect())
    if name in catalogue.ORACLES:
        found = db.execute(catalogue.ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        assert rows == sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())
