"""The landing stream with keyed state: equal to taking rows one by one, at a cost that does not grow."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from triagelake.operators import ingest
from triagelake.sources import files
from triagelake.streaming import landing

HEADER = ["ticket_id", "ticket_text", "category", "priority", "source", "notes"]


def land(folder, name, rows):
    with open(folder / name, "w", newline="") as f:
        csv.writer(f).writerows([HEADER, *([i, t, "Billing", "Low", "manual", ""] for i, t in rows)])


def one_by_one(batches):
    ids, texts, out = set(), set(), []
    for number, rows in enumerate(batches):
        for i, t in rows:
            ok = i not in ids and t not in texts
            out.append((number, i, t, ok))
            if ok:
                ids.add(i)
                texts.add(t)
    return sorted(out)


def written(spark, out):
    found = []
    for place in ("manual", "rejected"):
        rows = spark.read.option("mergeSchema", True).parquet(f"{out}/{place}").collect()
        found += [(r.batch, r.ticket_id, r.ticket_text, place == "manual") for r in rows]
    return sorted(found)


@pytest.fixture
def places(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/state"


def test_runs_equal_one_by_one_and_cost_the_same(spark, places):
    folder, source, out, state = places
    rng = random.Random(21)
    batches, asked, read = [], [], []
    for number in range(5):
        rows = [(f"i{rng.randrange(60)}", f"some text {rng.randrange(60)}") for _ in range(20)] + [("hot", f"hot text {number} {k}") for k in range(10)]
        land(folder, f"{number}.csv", rows)
        batches.append(rows)
        real = landing.take
        landing.take = lambda got, n, out, answers, through: (read.append(n - 1 - through), asked.append(answers.count()), real(got, n, out, answers, through))  # noqa: B023
        try:
            query = landing.ingest_stream(spark, source, out, state)
            query.awaitTermination()
        finally:
            landing.take = real
    assert written(spark, out) == one_by_one(batches)
    # Each batch asks for its own keys and takes in those of the batch before; no earlier folder is read.
    assert read == [0] * 5
    keys = [2 * ok for ok in (sum(r[3] for r in one_by_one(batches) if r[0] == n) for n in range(5))]
    for n in range(1, 5):
        assert asked[n] <= 2 * len(batches[n]) + keys[n - 1]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == sum(keys[:4])


@pytest.mark.parametrize("when", ["before routing", "before keys", "after keys"])
def test_a_crash_at_any_write_changes_nothing(spark, places, monkeypatch, when):
    folder, source, out, state = places
    batches = [[("a", "text one"), ("b", "text two"), ("a", "text six")], [("a", "text three"), ("c", "text two"), ("d", "text four")], [("d", "text nine"), ("e", "text five"), ("c", "text seven")]]
    land(folder, "0.csv", batches[0])
    landing.ingest_stream(spark, source, out, state).awaitTermination()
    land(folder, "1.csv", batches[1])
    target, name = {"before routing": (ingest, "write_routed"), "before keys": (files, "rename"), "after keys": (files, "write_json")}[when]

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(target, name, crash)
        with pytest.raises(Exception, match="lost"):
            landing.ingest_stream(spark, source, out, state).awaitTermination()
    land(folder, "2.csv", batches[2])
    landing.ingest_stream(spark, source, out, state).awaitTermination()
    landing.ingest_stream(spark, source, out, state).awaitTermination()
    assert written(spark, out) == one_by_one(batches)


def test_nothing_new_and_odd_rows(spark, places):
    folder, source, out, state = places
    land(folder, "0.csv", [("", "no id here"), ("x", ""), ("x", "a\nb text"), ("x", "a\nb text")])
    for _ in range(2):
        landing.ingest_stream(spark, source, out, state).awaitTermination()
    found = spark.read.parquet(f"{out}/rejected").groupBy("batch").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in found] == [(0, 3)]
    assert [r.ticket_text for r in spark.read.parquet(f"{out}/manual").collect()] == ["a\nb text"]


def test_one_call_of_the_state_serves_many_keys():
    from pyspark.sql import Row

    class Keys(dict):
        updateValue, containsKey = dict.__setitem__, dict.__contains__  # noqa: N815

    class Handle:
        def getMapState(self, *_):  # noqa: N802
            return Keys()

    known = landing.Known()
    known.init(Handle())
    row = lambda key, batch=None: Row(key=key, batch=batch)
    told = lambda *rows: [tuple(r) for r in known.handleInputRows((7,), iter(rows), None)]
    assert told(row(b"a"), row(b"b", 0), row(b"c", 0)) == [(b"b", True, 0), (b"c", True, 0)]
    assert told(row(b"a"), row(b"c"), row(b"a", 1), row(b"a")) == [(b"c", True, None), (b"a", True, 1), (b"a", True, None)]
