"""Every query of the package against its SQL counterpart."""

import pytest

from pagemill.llm.jobs import QUERIES
from pagemill.llm.sql import ORACLE


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in places) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, result.fetchall())
