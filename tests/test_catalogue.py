"""Every core query with a SQL twin gives its rows."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerloom import registry

FOLDER = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, str(FOLDER))
    r = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=repr) == want
