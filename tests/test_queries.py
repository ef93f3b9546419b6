"""Every query of the core that SQL can express gives the rows that the SQL gives, on whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from siltstone import plans

DATA = Path("/root/testdata/sf0.001")
ORACLES = plans.oracles()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def canonical(rows):
    return sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else repr(x) for x in r) for r in rows)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(plans.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, con, name):
    df = plans.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert canonical(rows) == canonical([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
