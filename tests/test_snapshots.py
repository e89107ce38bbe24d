"""Compaction of the event store against full replay, and what its relations demand against rows taken one by one."""

import random

import pytest
from pyspark.sql import functions as F

from triagelake.operators import constraints, snapshots, store


def events_of(rng, first, n):
    """Random puts and deletes of 40 tickets."""
    return [(first + i, rng.choice(["put", "put", "put", "delete"]), rng.randrange(40), f"T{rng.randrange(40)}", f"text {first + i}", rng.choice(["Open", None, "Closed"])) for i in range(n)]


def replay(events):
    now = {}
    for seq, kind, id_, ticket, text, status in events:
        if kind == "delete":
            now.pop(ticket, None)
        else:
            now[ticket] = (seq, id_, ticket, text, status)
    return sorted(now.values())


def read(spark, path):
    return sorted(tuple(r) for r in store.state(spark, path, "tickets", "ticket_id").select("seq", "id", "ticket_id", "ticket_text", "status").collect())


def append(spark, path, events):
    for kind in ("put", "delete"):
        rows = [(s, i, t, x, st) for s, k, i, t, x, st in events if k == kind]
        store.append(spark.createDataFrame(rows, "seq long, id long, ticket_id string, ticket_text string, status string"), path, "tickets", kind)


@pytest.mark.parametrize("bucket_rows", [1000, 6])
def test_snapshot_and_tail_equal_replay(spark, tmp_path, bucket_rows):
    path, rng, all_events = f"file://{tmp_path}/store", random.Random(bucket_rows), []
    store.create(spark, path)
    assert store.compact(spark, path, "tickets", bucket_rows) >= 0 and read(spark, path) == []
    for turn in range(4):
        events = events_of(rng, len(all_events) + 1, 30)
        append(spark, path, events)
        all_events += events
        assert read(spark, path) == replay(all_events)
        assert store.next_seq(spark, path, "tickets") == len(all_events) + 1
        if turn != 1:
            assert store.compact(spark, path, "tickets", bucket_rows) > 0
            assert read(spark, path) == replay(all_events)
            assert store.next_seq(spark, path, "tickets") == len(all_events) + 1
    found = snapshots.pointer(spark, path, "tickets")
    assert found["through"] == len(all_events) and found["rows"] == len(replay(all_events))
    assert store.compact(spark, path, "tickets", bucket_rows) == 0 and read(spark, path) == replay(all_events)  # nothing new
    found = snapshots.pointer(spark, path, "tickets")
    # Another session does not know the table yet.
    spark.sql(f"drop table `{found['table']}`")
    assert read(spark, path) == replay(all_events)


def test_only_the_tail_is_shuffled(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.create(spark, path)
    append(spark, path, events_of(random.Random(1), 1, 200))
    store.compact(spark, path, "tickets", 8)
    append(spark, path, events_of(random.Random(2), 201, 10))
    rows = store.state(spark, path, "tickets", "ticket_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    snapshot = next(part for part in plan.split("\n") if "Bucketed: true" in part or "SelectedBucketsCount" in part)
    assert snapshot
    from_snapshot = plan.split("SortMergeJoin")[1].split("FileScan")[1 - 1]
    assert "Exchange" not in from_snapshot
    scanned = rows.inputFiles()
    assert sum("/snapshots/" in f for f in scanned) >= 2


def test_a_failed_compaction_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    store.create(spark, path)
    events = events_of(random.Random(3), 1, 50)
    append(spark, path, events)
    store.compact(spark, path, "tickets")
    more = events_of(random.Random(4), 51, 20)
    append(spark, path, more)
    with monkeypatch.context() as patch:
        patch.setattr(snapshots.files, "write_json", lambda *_: (_ for _ in ()).throw(OSError("full")))
        with pytest.raises(OSError):
            store.compact(spark, path, "tickets")
    assert read(spark, path) == replay(events + more)


TICKET = "seq long, id long, ticket_id string, ticket_text string, category string, priority string, department string, confidence double, assigned_agent_id long"


def one_by_one(rows, there, agents):
    ids, tickets, out = {r[1] for r in there}, {r[2] for r in there}, {}
    for r in sorted(rows):
        seq, id_, ticket, text, category, priority, department, confidence, agent = r
        named = dict(ticket_id=ticket, ticket_text=text, category=category, priority=priority, department=department, confidence=confidence)
        why = next((f"NOT NULL constraint failed: tickets.{c}" for c, v in named.items() if v is None), None)
        if not why and agent is not None and agent not in agents:
            why = "FOREIGN KEY constraint failed: tickets.assigned_agent_id"
        if not why and id_ is not None and id_ in ids:
            why = "UNIQUE constraint failed: tickets.id"
        if not why and ticket in tickets:
            why = "UNIQUE constraint failed: tickets.ticket_id"
        if not why:
            ids.add(id_)
            tickets.add(ticket)
        out[seq] = why
    return out


def test_demands_by_one_by_one(spark, tmp_path):
    rng, path = random.Random(6), f"file://{tmp_path}/store"
    make = lambda seq: (seq, rng.choice([None, *range(30)]), rng.choice([None, *(f"T{k}" for k in range(30))]), rng.choice(["x", "x", "x", "x", None]), "Billing", "Low", "Team", 0.5, rng.choice([None, 1, 2, 3, 99]))
    store.create(spark, path)
    agents = spark.createDataFrame([(i, i, f"A{i}", "Team", 1) for i in (1, 2, 3)], "seq long, id long, name string, department string, is_active int")
    assert constraints.append_checked(agents, path, "agents").count() == 0
    again = constraints.append_checked(agents.withColumns({"seq": F.col("seq") + 10, "id": F.col("id") + 10}), path, "agents").collect()
    assert {r.violation for r in again} == {"UNIQUE constraint failed: agents.name, agents.department"}
    first, second = [make(i) for i in range(1, 40)], [make(i) for i in range(40, 90)]
    wanted = one_by_one(first, [], {1, 2, 3})
    told = {r.seq: r.violation for r in constraints.append_checked(spark.createDataFrame(first, TICKET), path, "tickets").collect()}
    assert told == {k: v for k, v in wanted.items() if v}
    store.compact(spark, path, "tickets", 5)
    there = [tuple(r) for r in store.state(spark, path, "tickets", "ticket_id").select("seq", "id", "ticket_id").collect()]
    assert len(there) == sum(v is None for v in wanted.values())
    wanted = one_by_one(second, there, {1, 2, 3})
    told = {r.seq: r.violation for r in constraints.append_checked(spark.createDataFrame(second, TICKET), path, "tickets").collect()}
    assert told == {k: v for k, v in wanted.items() if v} and len(set(told.values())) >= 4
    tickets = store.state(spark, path, "tickets", "ticket_id")
    left = constraints.without_agents(tickets, spark.createDataFrame([(1,), (1,)], "id long"))
    assert left.count() == tickets.count() and left.where("assigned_agent_id = 1").isEmpty()
    assert left.where("assigned_agent_id = 2").count() == tickets.where("assigned_agent_id = 2").count()


def test_the_slower_of_two_writers_is_told(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.create(spark, path)
    row = lambda seq, status: spark.createDataFrame([(seq, 1, "T1", status)], "seq long, id long, ticket_id string, status string")
    seq = store.next_seq(spark, path, "tickets")
    store.append(row(seq, "Open"), path, "tickets", expect=seq)
    for late in (seq, seq):
        with pytest.raises(store.Conflict):
            store.append(row(late, "Closed"), path, "tickets", expect=late)
    again = store.next_seq(spark, path, "tickets")
    store.claim(spark, path, "tickets", again)
    with pytest.raises(store.Conflict):
        store.append(row(again, "Closed"), path, "tickets", expect=again)
    store.append(row(again + 1, "Closed"), path, "tickets", expect=again + 1)
    assert [r.status for r in store.state(spark, path, "tickets", "ticket_id").collect()] == ["Closed"]


def test_a_first_snapshot_is_counted_by_its_keys(spark, tmp_path, monkeypatch):
    """The buckets follow from the rows that stay, and no row is made whole to count them."""
    path, counted, kind = f"file://{tmp_path}/store", [], type(spark.range(1))
    store.create(spark, path)
    events = events_of(random.Random(5), 1, 60)
    append(spark, path, events)
    real = kind.count
    with monkeypatch.context() as patch:
        patch.setattr(kind, "count", lambda self: (counted.append((self.columns, real(self))), counted[-1][1])[1])
        store.compact(spark, path, "tickets", 7)
    n = len(replay(events))
    assert counted[0] == (["ticket_id", "seq"], n) and snapshots.pointer(spark, path, "tickets")["buckets"] == -(-n // 7)
    assert read(spark, path) == replay(events)


def test_replayed_rows_are_made_once(spark, monkeypatch):
    from triagelake.plans.queries import QUERIES

    read_from, real = [], store.append
    monkeypatch.setattr(store, "append", lambda rows, *a, **k: (read_from.extend(rows.inputFiles()), real(rows, *a, **k)))
    assert QUERIES["store_replay"](spark, "/root/testdata/sf0.001").count() > 0
    assert read_from and not any("orders.parquet" in f for f in read_from)
