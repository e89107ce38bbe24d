"""SQLite tables read in ranges equal the Parquet tables they were written from."""

import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from triagelake.operators import store
from triagelake.sources import sqlite
from triagelake.sources import tickets as S

SMALL = "/root/testdata/sf0.001"
DECLARED = {
    "agents": "id integer primary key autoincrement, name text not null, department text not null, is_active integer not null default 1",
    "tickets": "id integer primary key autoincrement, ticket_id text unique not null, ticket_text text, category text, priority text, department text, confidence real, category_confidence real, priority_confidence real, created_at timestamp, assigned_agent_id integer",
    "priority_feedback": "id integer, feedback_id text, ticket_id text, corrected_priority text, validated integer default 0",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "st ore.db")
    frames = {"agents": S.agents(spark), "tickets": S.store_tickets(spark, SMALL).withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), "priority_feedback": S.feedback(spark, SMALL)}
    db = sqlite3.connect(path)
    for name, rows in frames.items():
        db.execute(f"create table {name} ({DECLARED[name]})")
        columns = [c.split()[0] for c in DECLARED[name].split(", ")]
        given = [tuple(str(x) if isinstance(x, datetime) else x for x in r) for r in rows.select(*columns).collect()]
        db.executemany(f"insert into {name} values ({', '.join('?' * len(columns))})", given)
        frames[name] = rows.select(*columns)
    db.execute("create table empty (a integer, b text)")
    db.execute('create table odd ("a ""b" int, v varchar(9), w blob, x double, z)')
    db.executemany("insert into odd values (?, ?, ?, ?, ?)", [(1, "é", b"\0", 1, "t"), (None, None, None, None, None), (3, "", b"", 2.5, 7)])
    db.execute("create table mixed (n integer)")
    db.execute("insert into mixed values ('not a number')")
    db.commit()
    db.close()
    return path, frames


def same(got, wanted):
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, wanted.select(*got.columns).collect()), key=key)


@pytest.mark.parametrize("partitions", [1, 5])
def test_tables_equal_parquet(spark, tables, partitions):
    path, frames = tables
    for name, rows in frames.items():
        got = sqlite.read_table(spark, path, name, partitions)
        assert got.rdd.getNumPartitions() == partitions
        same(got, rows.withColumn("validated", F.col("validated").cast("long")) if "validated" in rows.columns else rows)


def test_conditions_and_columns(spark, tables):
    path, frames = tables
    for where, plain in (
        ([("priority", "=", "High"), ("id", ">", 100)], "priority = 'High' and id > 100"), ([("category", "in", ["Refund", "Billing"])], "category in ('Refund', 'Billing')"), ([("category", "in", [])], "false"),
        ([("assigned_agent_id", "is", None)], "assigned_agent_id is null"), ([("assigned_agent_id", "is not", None), ("assigned_agent_id", "<>", 3)], "assigned_agent_id <> 3"),
        ([("confidence", ">=", 50), ("confidence", "<", 70.5)], "confidence >= 50 and confidence < 70.5"), ([("ticket_id", "starts with", "TICK-1")], "ticket_id like 'TICK-1%'"), ([("ticket_text", "contains", "order")], "contains(ticket_text, 'order')"),
        ([("created_at", "<=", "1995-01-01 00:00:00")], "created_at <= timestamp_ntz'1995-01-01'"),
    ):
        got = sqlite.read_table(spark, path, "tickets", 3, ["ticket_id", "id"], where)
        assert got.columns == ["ticket_id", "id"]
        same(got, frames["tickets"].where(plain))
    with pytest.raises(Exception, match="not by like"):
        sqlite.read_table(spark, path, "tickets", where=[("id", "like", "x")]).collect()
    with pytest.raises(Exception, match="has no column nothing"):
        sqlite.read_table(spark, path, "tickets", columns=["nothing"])


def test_queries_on_one_frame_do_not_disturb_each_other(spark, tables):
    path, frames = tables
    got, n = sqlite.read_table(spark, path, "tickets", 3), frames["tickets"].count()
    assert got.where("id > 100").count() < n == got.count()
    assert got.where("priority = 'High'").count() == frames["tickets"].where("priority = 'High'").count()


def test_odd_tables(spark, tables):
    path, _ = tables
    assert sqlite.read_table(spark, path, "empty").collect() == []
    rows = sqlite.read_table(spark, f"file://{path.replace(' ', '%20')}", "odd", 9)
    assert rows.dtypes == [('a "b', "bigint"), ("v", "string"), ("w", "binary"), ("x", "double"), ("z", "string")]
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, "é", b"\0", 1.0, "t"), (None,) * 5, (3, "", b"", 2.5, "7")], key=str)
    with pytest.raises(Exception, match="there is no table"):
        sqlite.read_table(spark, path, "absent")
    with pytest.raises(Exception, match="which is no bigint"):
        sqlite.read_table(spark, path, "mixed").collect()


def test_store_queries_run_over_it(spark, tables):
    """What the service asks of its store, asked of SQLite's tables and of Parquet's."""
    path, frames = tables
    tickets, agents, told = (sqlite.read_table(spark, path, n, 4) for n in ("tickets", "agents", "priority_feedback"))
    same(store.with_agent(tickets, agents).select("ticket_id", "agent"), store.with_agent(frames["tickets"], frames["agents"]))
    same(store.dashboard(tickets, told), store.dashboard(frames["tickets"], frames["priority_feedback"]))
    same(store.feedback_with_ticket(told, tickets).select("feedback_id", "ticket_text", "original_priority"), store.feedback_with_ticket(frames["priority_feedback"], frames["tickets"]))
