"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

from assetflow.plans import catalog, follow, models, older, pictures, stages, storage  # noqa: F401 - they register their queries
from assetflow.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    value = lambda v: round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, str, bool)) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = sql.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    assert rows, "nothing is compared with nothing"
    assert plain(rows) == plain(sql.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
