"""The acceptance fold against taking rows one by one, by each of its ways."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from triagelake.operators import fold, ingest
from triagelake.plans.oracles import oracle_sql
from triagelake.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def one_by_one(rows):
    ids, texts, out = set(), set(), []
    for n, a, b in sorted(rows):
        if a is not None and b is not None and a not in ids and b not in texts:
            ids.add(a)
            texts.add(b)
            out.append(n)
    return out


def accepted(spark, rows, bound):
    frame = spark.createDataFrame(rows, "n long, a string, b string").repartition(4)
    return sorted(r._ord for r in fold.first_come(frame, "n", F.col("a"), F.col("b"), bound).collect())


def chain(n, start=0):
    """Each row shares its id with the row before and its text with the row after, or the other way round."""
    return [(start + i, f"i{start}-{i // 2}", f"t{start}-{(i + 1) // 2}") for i in range(n)]


@pytest.mark.parametrize("bound", [1000, 30, 7])
def test_by_brute_force(spark, bound):
    rng = random.Random(bound)
    rows = [(n, f"i{rng.randrange(60)}", f"t{rng.randrange(60)}") for n in rng.sample(range(1000), 150)]
    rows += [(2000 + n, "hot", f"h{n % 9}") for n in range(40)] + [(3000, None, "t1"), (3001, "i1", None), (3002, "new", "")]
    rows += chain(25, 4000)
    assert accepted(spark, rows, bound) == one_by_one(rows)


def test_shuffled_chain(spark):
    """Rows of a chain in random order, so that what is accepted depends on stretches of it."""
    rows = chain(90)
    order = random.Random(3).sample(range(90), 90)
    rows = [(n, a, b) for n, (_, a, b) in zip(order, rows, strict=True)]
    assert accepted(spark, rows, 20) == one_by_one(rows)


def test_long_chain_takes_few_jobs(spark):
    """10,000 rivals: rounds that settle the first alone would take 5,000."""
    rows = chain(10_000)
    frame = spark.createDataFrame(rows, "n long, a string, b string")
    spark.sparkContext.setJobGroup("chain", "")
    writes = []
    real = fold.files.written
    fold.files.written = lambda rows, tag: writes.append(tag) or real(rows, tag)
    try:
        got = sorted(r._ord for r in fold.first_come(frame, "n", F.col("a"), F.col("b")).collect())
    finally:
        fold.files.written = real
        spark.sparkContext._jsc.clearJobGroup()
    assert got == one_by_one(rows)
    assert writes == ["open", "firsts", "open", "folded"]


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"{rng.randrange(80):02}", f"{rng.randrange(80):02}") for _ in range(60)] + [(f"x{i:03}", f"x{i + 1:03}") for i in range(100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.root for r in fold.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {x: got.get(x, x) for x in root} == {x: find(x) for x in root}


def test_odd_rows(spark):
    assert accepted(spark, [], 10) == []
    assert accepted(spark, [(1, None, None)], 10) == []
    assert accepted(spark, [(5, "a", "b"), (4, "a", "c"), (3, "d", "c")], 1) == [3, 5]


def test_query_equals_recursive_sql(spark):
    db = duckdb.connect()
    for name in ("orders", "lineitem"):
        db.sql(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    wanted = sorted(db.sql(oracle_sql()["ingest_fold"]).fetchall(), key=str)
    got = sorted(map(tuple, QUERIES["ingest_fold"](spark, SMALL).select("row_ord", "validation_status", "rejection_reason").collect()), key=str)
    assert got == wanted and {r[1] for r in got} == {"approved", "rejected"}


def test_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, "a", "text one", "Billing", "Low", None, "extra")], "row_ord long, ticket_id string, ticket_text string, category string, priority string, source string, _n string")
    got = ingest.accept(rows, rows.limit(0))
    assert set(got.columns) == {*rows.columns, "validation_status", "rejection_reason"}
    assert got.first().validation_status == "approved"
