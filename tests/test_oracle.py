"""Every query of the library's own operators against its SQL twin."""

import pytest

from plinthwork.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return {d: connect(d) for d in (SF, LARGER)}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, name):
    """Equal rows, and some: on the larger tables where the smallest give none."""
    query = registry.queries()[name]
    for d in (SF, LARGER):
        found = compare(spark, con[d], query, SQL[name], d) if name in SQL else "" if query(spark, d).count() else "no rows"
        if found != "no rows":
            break
    assert not found
