"""Every query against its oracle, value by value."""

from decimal import Decimal

import pytest
from conftest import DATA

from textloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    ours = QUERIES[name](spark, DATA)
    columns = sorted(ours.columns)
    rows = [tuple(r[c] for c in columns) for r in ours.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = [tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()]
    near = lambda v: f"{float(v) + 0.0:.4f}" if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)
    assert sorted(tuple(map(near, r)) for r in rows) == sorted(tuple(map(near, r)) for r in theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
