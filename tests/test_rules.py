"""Rules by index against every pattern run over every text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from triagelake import fixed
from triagelake.operators import rules


def test_every_signal_rule_has_keys_that_its_matches_hold():
    rows = rules.rule_rows(fixed.SIGNALS)
    assert len(rows) > 150 and all(keys for *_, keys in rows)
    by_pattern = {p: k for *_, p, k in rows}
    assert by_pattern[r"\bneed\s+help\s+now\b"] == ["w:help", "w:need", "w:now"]
    assert by_pattern[r"\bdelayed\s+for\s+(?:two|several|\d+)\s+weeks\b"] == ["w:delayed", "w:for", "w:weeks"]
    assert by_pattern["હેક"] == ["g:હેક"]


def sentences(rng, n):
    parts = [re.sub(r"\(\?:([^|]*)[^)]*\)", r"\1", p).replace("\\b", "").replace("\\s+", " ").replace("\\s*", " ").replace("\\d+", "7") for *_, p, _ in rules.rule_rows(fixed.SIGNALS)]
    filler = ["the", "page", "é", "crashé", "my", "_slow", "slow", "status2", "?", "needs", "હેકર", "\n"]
    return ["".join(rng.choice(["", " ", ", ", "x", "É"]) + (rng.choice(parts) if rng.random() < 0.4 else rng.choice(filler)) for _ in range(rng.randint(0, 9))).swapcase() for _ in range(n)]


def test_signals_equal_the_unrolled_ones(spark):
    rng = random.Random(15)
    texts = [*sentences(rng, 300), "", None, "URGENT urgent", "a" * 20_000, "slow " * 5000]
    frame = spark.createDataFrame(list(enumerate(texts)), "ticket_id long, ticket_text string").repartition(3)
    table = rules.rule_table(spark, fixed.SIGNALS)
    got = sorted(map(tuple, rules.signal_scores(frame, table, "ticket_id", tuple(fixed.SIGNALS)).collect()))
    from triagelake.functions import text as X

    assert got == sorted(map(tuple, frame.select("ticket_id", *[X.signal(F.col("ticket_text"), s).alias(s) for s in fixed.SIGNALS]).collect()))
    rows = rules.rule_rows(fixed.SIGNALS)
    assert got == sorted(map(tuple, frame.select("ticket_id", *[rules.unrolled(rows, F.col("ticket_text"), s).alias(s) for s in fixed.SIGNALS]).collect()))
    found = sorted(map(tuple, rules.hits(frame, table, "ticket_id").collect()))
    assert found == sorted(map(tuple, rules.hits(frame, table, "ticket_id", broadcast=0).collect())) and len(found) > 200


def test_ten_thousand_rules(spark):
    """Two-word rules over a small vocabulary: as many hits as plain string search finds."""
    rng = random.Random(16)
    words = [f"w{i}" for i in range(400)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(10_000)]
    rows = [(i, f"s{i % 5}", (i % 97) / 97, rf"\b{a}\s+{b}\b", rules.keys_of(rf"\b{a}\s+{b}\b")) for i, (a, b) in enumerate(pairs)]
    texts = [" ".join(rng.choice(words[:200] if k % 2 else words) for _ in range(12)) for k in range(500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "ticket_id long, ticket_text string")
    got = sorted((r.ticket_id, r.rule) for r in rules.hits(frame, spark.createDataFrame(rows, rules.SCHEMA), "ticket_id").collect())
    of_pair = {}
    for i, pair in enumerate(pairs):
        of_pair.setdefault(pair, []).append(i)
    wanted = {(k, i) for k, t in enumerate(texts) for pair in zip(t.split(), t.split()[1:], strict=False) for i in of_pair.get(pair, ())}
    assert got == sorted(wanted) and got


def test_odd_rules(spark):
    frame = spark.createDataFrame([(1, "a b")], "ticket_id long, ticket_text string")
    none = spark.createDataFrame([], rules.SCHEMA)
    assert rules.hits(frame, none, "ticket_id").count() == 0
    assert rules.signal_scores(frame, none, "ticket_id", ("x",)).collect()[0].x == 0.0
    with pytest.raises(ValueError):
        rules.hits(frame, rules.rule_table(spark, {"x": [(r"\b(\d+)\b", 1.0)]}), "ticket_id")
    assert rules.hits(frame.limit(0), rules.rule_table(spark, fixed.SIGNALS), "ticket_id").count() == 0
