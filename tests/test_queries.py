"""Every registered query of the library against its SQL."""

import pytest

from docweave import plans
from oracle import same_rows


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, sf, name):
    same_rows(plans.QUERIES[name](spark, sf), plans.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert [r["key"] for r in rows] == [str(k) for k in range(1, len(rows) + 1)]
    assert rows and all(a["score"] >= b["score"] for a, b in zip(rows, rows[1:]))
