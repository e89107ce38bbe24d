"""Preparation, ingestion, evaluation, store, sources and streaming on small frames."""

import csv
import random
import re

import pytest
from pyspark.sql import functions as F

from triagelake import fixed
from triagelake.operators import evaluate, ingest, prepare, profile, store
from triagelake.plans.queries import QUERIES
from triagelake.sources import tickets as S
from triagelake.streaming import landing
from triagelake.streaming.landing import ingest_stream

SMALL = "/root/testdata/sf0.001"
ROWS = "row_ord long, ticket_id string, ticket_text string, category string, priority string, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, "Billing", "Low", "manual") for i, (t, x) in enumerate(rows)], ROWS)


def decided(spark, rows, existing=()):
    got = ingest.accept(frame(spark, rows), frame(spark, existing)).orderBy("row_ord").collect()
    return [(r.validation_status, r.rejection_reason) for r in got]


def test_fold_counts_accepted_rivals_only(spark):
    got = decided(spark, [("a", "text one"), ("a", "text two"), ("c", "text two"), ("d", "TEXT one"), ("e", "text three")])
    assert [s for s, _ in got] == ["approved", "rejected", "approved", "rejected", "approved"]
    assert got[1][1] == "Duplicate ticket_id 'a'" and got[3][1] == "Exact duplicate ticket_text already in dataset"


def test_fold_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(f"i{rng.randrange(12)}", f"some text {rng.randrange(12)}") for _ in range(60)]
    ids, texts, wanted = set(), set(), []
    for i, t in rows:
        ok = i not in ids and t not in texts
        wanted.append("approved" if ok else "rejected")
        if ok:
            ids.add(i)
            texts.add(t)
    assert [s for s, _ in decided(spark, rows)] == wanted


def test_replay_is_rejected_with_reasons(spark):
    rows = [("INC_001", "My bill is wrong"), ("INC_003", "mail me a@b.com or 555-123-4567 now"), ("INC_004", "abc"), (None, None)]
    got = decided(spark, rows, [("INC_001", "my BILL is wrong ")])
    assert got[0][1] == "Duplicate ticket_id 'INC_001'; Exact duplicate ticket_text already in dataset"
    assert got[1][1] == "PII detected: Email address detected, Phone number detected"
    assert got[2][1] == "Text too short (3 chars, min 5)"
    assert got[3][1] == "Missing ticket_id; Missing or empty ticket_text"


def test_split_keeps_templates_whole(spark):
    rows = prepare.keep_first(prepare.clean_rows(S.raw_tickets(spark, SMALL)))
    split = prepare.with_split(rows).withColumn("pattern", prepare.X.signature(F.col("ticket_text")))
    assert split.count() == rows.count() == rows.select("ticket_text").distinct().count()
    assert split.groupBy("pattern").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert split.where("split = 'train'").select("category").distinct().count() == 8
    raw = S.raw_tickets(spark, SMALL)
    record = prepare.version_record(raw, rows, prepare.with_split(rows), "v1", "2026-01-01T00:00:00")
    assert record["total_raw"] == raw.count() and record["total_cleaned"] == record["unique_records"] == rows.count() == sum(record["splits"].values()) == sum(record["category_distribution"].values())
    assert all(v == 0 for pair in record["leakage"].values() for v in pair.values()) and set(record["priority_distribution"]) == set(fixed.PRIORITIES)
    ids = [r.ticket_id for r in prepare.numbered(rows).orderBy("row_ord").collect()]
    assert ids == [f"T{i + 1:05d}" for i in range(len(ids))]


def test_scores(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    each = {r.label: (r.precision, r.recall, r.f1, r.support) for r in evaluate.per_class(rows, "y", "p").collect()}
    assert each == {"a": (1.0, 0.5, 0.666667, 2), "b": (0.333333, 1.0, 0.5, 1), "c": (0.0, 0.0, 0.0, 1)}
    assert evaluate.accuracy(rows, "y", "p").first()[0] == 0.5
    assert evaluate.promotion(0.5, 0.5, 0.85) and not evaluate.promotion(0.4, 0.5, 0.9)


def test_profile(spark):
    rows = spark.createDataFrame([("x", "urgent refund today refund", "Low", "Refund"), (None, "", "High", "Billing")], "k string, t string, priority string, category string")
    assert profile.length_buckets(rows, "t").first().short == 2
    words = {r.word: r.n for r in profile.keyword_profile(rows, "t").collect()}
    assert words["refund"] == 1 and words["parcel"] == 0
    assert rows.limit(1).select(profile.ngrams(F.col("t"), 2)).first()[0] == ["urgent refund", "refund today", "today refund"]
    assert rows.select(profile.ngrams(F.lit("one"), 2)).first()[0] == []


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.create(spark, path)
    rows = spark.createDataFrame([(1, 1, "TICK-1", "Open"), (2, 2, "TICK-2", "Open")], "seq long, id long, ticket_id string, status string")
    store.append(rows, path, "tickets")
    store.append(rows.where("id = 1").withColumns({"seq": F.lit(3), "status": F.lit("Closed")}), path, "tickets")
    store.append(rows.where("id = 2").withColumn("seq", F.lit(4)), path, "tickets", "delete")
    now = store.latest(spark.read.parquet(f"{path}/tickets"), "ticket_id").collect()
    assert [(r.ticket_id, r.status) for r in now] == [("TICK-1", "Closed")]


def test_assignment(spark):
    agents = spark.createDataFrame([(1, "A", "X", 1), (2, "B", "X", 0), (3, "C", "Y", 1), (4, "D", "Y", 1)], "id long, name string, department string, is_active int")
    tickets = spark.createDataFrame([("t1", "X", None), ("t2", "X", 1), ("t3", "Y", 3), ("t4", "Z", None)], "ticket_id string, department string, assigned_agent_id long")
    got = {r.ticket_id: (r.agent_id, r.status) for r in store.assign(tickets, agents).collect()}
    assert got == {"t1": (1, 200), "t2": (None, 409), "t3": (4, 200), "t4": (None, 409)}


def write_csv(path, rows):
    with open(path, "w", newline="") as f:
        csv.writer(f).writerows([["ticket_id", "ticket_text", "category", "priority", "source", "created_at"], *rows])


def test_sources(spark, tmp_path):
    write_csv(tmp_path / "manual.csv", [["1", 'He said "no",\nthen left', "Billing", "Low", "", "NA"]])
    rows = S.read_available(spark, {f"file://{tmp_path}/manual.csv": "manual", f"file://{tmp_path}/none.csv": "external"}, S.INCOMING).collect()
    assert [(r.ticket_text, r.source, r.created_at) for r in rows] == [('He said "no",\nthen left', "manual", None)]
    with pytest.raises(FileNotFoundError):
        S.read_available(spark, {f"file://{tmp_path}/none.csv": "x"})
    with pytest.raises(KeyError):
        S.require(spark.range(1).toDF("ticket_id"))
    made = S.generate(spark, 200)
    assert made.count() == 200 and made.exceptAll(S.generate(spark, 200)).isEmpty()
    assert made.select("priority").distinct().count() >= 3


def test_stream(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    write_csv(folder / "a.csv", [["1", "first text", "Billing", "Low", "manual", ""], ["2", "second text", "Refund", "High", "external", ""], ["1", "third text", "Refund", "High", "external", ""]])
    run = lambda: ingest_stream(spark, f"file://{folder}", f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    run()
    count = lambda name: spark.read.parquet(f"file://{tmp_path}/out/{name}").count()
    assert (count("manual"), count("external"), count("rejected")) == (1, 1, 1)
    write_csv(folder / "b.csv", [["2", "second text", "Refund", "High", "external", ""]])
    write_csv(folder / "processed_c.csv", [["9", "not to be read", "Refund", "High", "external", ""]])
    run()
    assert (count("manual"), count("external"), count("rejected")) == (1, 1, 2)
    reasons = {(r.batch, r.rejection_reason) for r in spark.read.parquet(f"file://{tmp_path}/out/rejected").collect()}
    assert reasons == {(0, "Duplicate ticket_id '1'"), (1, "Duplicate ticket_id '2'; Exact duplicate ticket_text already in dataset")}


def test_a_batch_that_comes_again_decides_the_same(spark, tmp_path, monkeypatch):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(0, "1", "first text", "Billing", "Low", "manual"), (1, "1", "third text", "Refund", "High", "external"), (2, "3", "no", "Refund", "High", "external")], ROWS).drop("row_ord").withColumn("file_name", F.lit("a.csv")).coalesce(1)
    seen = lambda: {p: sorted(map(str, spark.read.parquet(f"{out}/{p}").drop("batch").collect())) for p in ingest.PLACES}
    landing.take(rows, 0, out)
    first = seen()
    assert [len(v) for v in first.values()] == [1, 0, 2]
    real = ingest.write_routed

    def crashing(decided, place, batch):
        decided.where("validation_status = 'approved' and source = 'manual'").drop("rejection_reason").write.mode("overwrite").parquet(f"{place}/manual/batch={batch}")
        raise RuntimeError("lost between the writes")

    more = rows.withColumn("ticket_id", F.concat("ticket_id", F.lit("x"))).withColumn("ticket_text", F.concat("ticket_text", F.lit(" again")))
    monkeypatch.setattr(ingest, "write_routed", crashing)
    with pytest.raises(RuntimeError):
        landing.take(more, 1, out)
    monkeypatch.setattr(ingest, "write_routed", real)
    landing.take(more, 1, out)
    landing.take(more, 1, out)
    assert [len(v) for v in seen().values()] == [2, 1, 3]
    landing.take(rows, 0, out)
    assert {k: set(v) <= set(seen()[k]) for k, v in first.items()} == dict.fromkeys(ingest.PLACES, True)


def test_benchmark_passages_by_brute_force(spark):
    rng = random.Random(8)
    some = lambda n: [rng.choice("abcdefgh") * rng.randint(1, 40) for _ in range(n)]
    items = {i: some(n) for i, n in enumerate((1, 3, 12, 13, 14, 30, 60))} | {90: [], 91: None}
    docs = {i: some(rng.randint(0, 40)) for i in range(40)} | {50: None}
    for i, (item, n) in enumerate(((1, 3), (2, 12), (2, 11), (3, 13), (4, 13), (5, 13), (5, 12), (6, 60))):
        docs[60 + i] = some(5) + items[item][-n:] + some(4)
    text = lambda words: None if words is None else "".join(w.upper() + rng.choice([" ", "\n", "  ", "\n\n"]) for w in words)
    frame = lambda rows, key: spark.createDataFrame([(i, text(w)) for i, w in rows.items()], f"{key} long, text string").repartition(3)

    def shares(item, doc):
        n = min(13, len(item))
        runs = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)}
        return n > 0 and any(tuple(doc[i : i + n]) in runs for i in range(len(doc) - n + 1))

    wanted = {(a, b) for a, x in items.items() for b, y in docs.items() if x and y and shares(x, y)}
    got = prepare.shared_passages(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and {(1, 60), (2, 61), (5, 65), (6, 67)} <= wanted and (2, 62) not in wanted


def test_every_ticket_is_signed(spark):
    rows = S.tickets(spark, SMALL).select("ticket_id", "ticket_text").collect()
    assert any(re.search("[\u0a80-\u0aff]", r.ticket_text) for r in rows)

    def signed(text):
        text = text.lower().strip()
        for pattern, by in fixed.MASKS:
            text = re.sub(pattern, by, text)
        text = re.sub(r"\s+", " ", text).strip()
        for phrase in fixed.NOISE:
            text = text.replace(phrase, "").strip()
        return text

    got = QUERIES["template_signature"](spark, SMALL).collect()
    assert sorted(map(tuple, got)) == sorted((r.ticket_id, signed(r.ticket_text)) for r in rows)


def test_softmax_makes_each_margin_once_a_row(spark):
    """By how often the plan holds a margin's own expression; the shares are hand-made."""
    rows = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (-1.0, 3.0)], "a double, b double").coalesce(1)
    plan = rows.select(evaluate.softmax({"a": F.rand() * 0 + F.col("a"), "b": F.col("b")}).alias("s"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("rand(") == 1
    got = [r.s for r in plan.collect()]
    assert got[0] == {"a": 26.89, "b": 73.11} and got[1] == {"a": 50.0, "b": 50.0} and got[2] == {"a": 1.8, "b": 98.2}


def test_a_pattern_that_is_there_is_not_made_again_and_shared_texts_are_counted_once(spark):
    rows = spark.createDataFrame([(0, "Case one", "A", "p"), (1, "Case two", "A", "q"), (2, " case one", "A", "p")], "row_ord long, ticket_text string, category string, pattern string")
    split = prepare.with_split(rows)
    assert {(r.row_ord, r.pattern) for r in split.collect()} == {(0, "p"), (1, "q"), (2, "p")}
    told = rows.withColumn("split", F.when(F.col("row_ord") == 2, "test").otherwise("train"))
    assert tuple(prepare.split_overlap(told.unionByName(told)).first()) == (1, 0, 1)
    assert tuple(prepare.split_overlap(told.unionByName(told.withColumn("split", F.lit("test"))).drop("pattern")).first()) == (2, 2, 2)


def test_violations_carry_only_what_is_wanted(spark):
    from triagelake.operators import constraints

    rows = spark.createDataFrame([(1, 1, "f1"), (2, 1, "f2"), (3, 9, "f3"), (4, 4, "f9"), (5, 5, "f1"), (6, None, "f2"), (7, 7, None)], "seq long, id long, feedback_id string")
    rows = rows.selectExpr("*", "'t' as ticket_id", "'Low' as original_priority", "'Low' as corrected_priority", "repeat('x', 100) as reason")
    there = spark.createDataFrame([(9, "f9")], "id long, feedback_id string")
    found = constraints.violations(rows, "priority_feedback", {"priority_feedback": there}, keep=("feedback_id",))
    assert found.columns == ["seq", "feedback_id", "violation"]
    why = {r.seq: r.violation and r.violation.rsplit(".", 1)[1] for r in found.collect()}
    assert why == {1: None, 2: "id", 3: "id", 4: "feedback_id", 5: "feedback_id", 6: None, 7: "feedback_id"}
