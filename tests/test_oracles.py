"""Every query that SQL can state gives the SQL's rows."""

import oracle
import pytest

from protospan.plans import analytics, core_problems, core_sql, details, files, relational, step_sql

QUERIES = {**core_problems.QUERIES, **relational.reg.queries, **analytics.reg.queries, **details.reg.queries, **files.reg.queries}
SQL = {**core_sql.SQL, **relational.reg.sql, **analytics.reg.sql, **details.reg.sql, **files.reg.sql, **step_sql.SQL}
SAMPLE = [n for n in SQL if n.startswith("p")] + [n for n in SQL if not n.startswith("p")]


MAY_BE_EMPTY = {"t15_uncorrelated", "t15_redundancy_filter"}  # no protein of the smallest tables is a marker


@pytest.fixture(scope="module")
def con(data):
    return oracle.connect(data)


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, data, con, name):
    assert oracle.differences(con, SQL[name], QUERIES[name](spark, data)) == (0, 0)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n not in ("p5_filled", "p1_report")])
def test_others_run(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and (df.count() > 0 or name in MAY_BE_EMPTY)
