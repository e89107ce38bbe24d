"""Sketches within their stated errors, kept by batch and merged; the dashboard in one scan."""

import random
import re

from pyspark.sql import functions as F

from triagelake.operators import sketches, store
from triagelake.sources import tickets as S

SMALL = "/root/testdata/sf0.001"


def test_many_texts_within_the_stated_error(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.concat(F.lit("ticket "), (F.col("id") % 45_000).cast("string"), F.repeat(F.lit(" word"), (F.col("id") % 37).cast("int"))).alias("ticket_text"), (F.col("id") % 3).cast("string").alias("source"), (F.col("id") % 7).alias("day")
    )
    path = f"file://{tmp_path}/sketches"
    for day in range(7):
        sketches.keep(rows.where(F.col("day") == day), path, "source", "day")
    kept = spark.read.parquet(path)
    assert kept.count() == 21
    whole = sketches.estimates(kept).first()
    distinct = rows.select("ticket_text").distinct().count()
    assert whole.n == 60_000 and abs(whole.texts - distinct) <= sketches.COUNT_ERROR * distinct
    words = sorted(1 + 1 + i % 37 for i in range(60_000))
    below = sum(w < whole.median_words for w in words) / len(words)
    upto = sum(w <= whole.median_words for w in words) / len(words)
    assert below <= 0.5 + sketches.RANK_ERROR and upto >= 0.5 - sketches.RANK_ERROR
    checked = sketches.checked(rows, kept, "source").collect()
    assert len(checked) == 3 and all(r.n_same and r.texts_near and r.templates_near and r.words_near and r.chars_near for r in checked)
    wrong = kept.withColumn("texts", F.first("texts").over(__import__("pyspark").sql.Window.partitionBy(F.lit(1)).orderBy("source", "day")))
    assert not all(r.texts_near for r in sketches.checked(rows, wrong, "source").collect())


def test_odd_groups(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", ""), ("b", "x"), (None, "y")], "source string, ticket_text string")
    got = {r.source: (r.n, r.texts, r.templates, r.median_words, r.near_duplicates) for r in sketches.estimates(sketches.sketch(rows, "source"), "source").collect()}
    assert got["a"] == (2, 0, 0, None, 2) and got["b"][:3] == (2, 2, 2) and got[None][:4] == (1, 1, 1, 1)
    assert sketches.estimates(sketches.sketch(rows.limit(0), "source"), "source").count() == 0


def test_dashboard_reads_tickets_once(spark):
    tickets, feedback = S.store_tickets(spark, SMALL), S.feedback(spark, SMALL)
    board = store.dashboard(tickets, feedback)
    plan = board._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[.*o_orderkey|Relation.*o_orderkey", plan)) == 1
    got = {(r.metric, r.key): r.n for r in board.collect()}
    assert got["total", "tickets"] == tickets.count() and sum(n for (m, _), n in got.items() if m == "priority") == tickets.count()
    empty = {(r.metric, r.key): r.n for r in store.dashboard(tickets.limit(0), feedback.limit(0)).collect()}
    assert empty == {("total", "tickets"): 0}
    rng = random.Random(3)
    odd = spark.createDataFrame([(rng.choice(["a", None]), rng.choice(["b", None]), None) for _ in range(50)], "category string, priority string, department string")
    counts = {(r.metric, r.key): r.n for r in store.dashboard(odd, feedback.limit(0)).collect()}
    assert counts["department", None] == 50 and counts["category", "a"] + counts["category", None] == 50
