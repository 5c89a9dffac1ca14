"""Every registered query next to its SQL, and a plain run of the others."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import canonical, oracle_session


@pytest.fixture(scope="module")
def oracle(folder):
    return oracle_session(folder)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, oracle, folder, name):
    df = queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    found = oracle.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, folder, name):
    assert queries()[name](spark, folder).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 1
