"""Every query with SQL gives the rows that the SQL gives; the others run."""

import pytest

from conftest import rows_of
from recallgrid.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, db, data):
    df = catalog.QUERIES[name](spark, data)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLES:
        want = db.execute(catalog.ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert found == rows_of(names, want.fetchall())
