"""Every query of the subpackage with SQL gives the SQL's rows, and all run, on the smallest tables."""

import pytest

from tagloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(same_rows, name):
    same_rows(queries.QUERIES[name], queries.SQL.get(name))


def test_names():
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert {"p2_found", "p3_found", "p6_found", "p7_ids", "p8_found", "p9_found"} <= set(queries.QUERIES)
