"""Every registered query on the smallest driver tables: against its SQL, or for rows and schema."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from tools.check import duck, norm

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    names = sorted(df.columns)
    got = Counter(tuple(norm(r[c]) for c in names) for r in df.collect())
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "source", "class", "turn", "place"] and df.count() > 0


def test_registry_needs_no_session_to_list_queries():
    assert set(SQL) <= set(QUERIES)
