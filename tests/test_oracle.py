"""Every query against its SQL counterpart at the smallest scale."""

import pytest

import __spark_entry__ as entry
from pagemill.plans.oracle import ORACLE
from pagemill.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in places) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    result = db.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert ordered(df.columns, df.collect()) == ordered(columns, result.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "url", "title", "markdown", "bad_link"]
    assert df.count() == 50
