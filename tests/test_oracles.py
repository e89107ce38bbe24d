"""Every registered query that has SQL gives the same rows as DuckDB does."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from triagelake.plans.oracles import oracle_sql
from triagelake.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, wanted = QUERIES[name](spark, SMALL), duck.sql(oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda data, names: sorted((tuple(r[names.index(c)] for c in columns) for r in data), key=repr)
    assert rows(got.collect(), got.columns) == rows(wanted.fetchall(), wanted.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_what_the_training_data_operators_need():
    import subprocess
    import sys

    blocked = "import sys; sys.modules['xxhash'] = None; sys.modules['tokenizers'] = None\nimport __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1') for n in q)"
    subprocess.run([sys.executable, "-c", blocked], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
