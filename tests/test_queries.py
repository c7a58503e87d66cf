"""Every query that isn't a training-text one runs at the smallest size and gives the rows of its SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lorevault.plans import registry
from verify import plain

SF = "/root/testdata/sf0.001"
QUERIES = {k: f for m in registry.modules() for k, f in m.queries().items()}
SQL = {k: s for m in registry.modules() for k, s in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in SQL:
        cur = db.execute(SQL[name])
        theirs = [d[0] for d in cur.description]
        assert sorted(theirs) == cols
        order = [theirs.index(c) for c in cols]
        assert got == Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    else:
        assert sum(got.values()) > 0


def test_entry_without_training_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
