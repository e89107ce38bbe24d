"""The text kernel on literal texts."""

import pytest
from pyspark.sql import functions as F

from triagelake import fixed
from triagelake.functions import text as X


def values(spark, texts, make):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    return [r.v for r in frame.orderBy("i").select(make(F.col("t")).alias("v")).collect()]


def test_clean_and_preprocess(spark):
    texts = ["Visit https://a.b/c?x=1 NOW!!", "<b>Bold</b> www.x.y text", "મારું એકાઉન્ટ હેક", "a1b2  c\t\n", None, "   ", "Where is THE order of mine? it's I"]
    assert values(spark, texts, X.clean) == ["visit now", "bold text", "મારું એકાઉન્ટ હેક", "a b c", "", "", "where is the order of mine it s i"]
    assert values(spark, [texts[-1], None], X.preprocess) == ["where order mine", ""]
    assert values(spark, ["Orders of the boxes"], lambda c: X.preprocess(c, {"orders": "order", "boxes": "box"})) == ["order box"]


SIGNAL_CASES = [
    ("I was charged twice and need a refund immediately.", (0.9, 0.0, 0.95, 0.0, 0.0, 0.9)),
    ("My account was hacked by unauthorized access.", (0.0, 0.0, 0.0, 1.0, 0.0, 0.0)),
    ("Our entire business service is unavailable due to system outage.", (0.0, 0.0, 0.0, 0.0, 1.0, 0.0)),
    ("Mera card do baar charge ho gaya hai jaldi help karo.", (0.9, 0.0, 0.95, 0.0, 0.0, 0.0)),
    ("Where can I find tracking information for my order?", (0.0,) * 6),
    ("My package is delayed by 2 days", (0.0, 0.0, 0.0, 0.0, 0.0, 0.65)),
    ("મારું એકાઉન્ટ હેક થઈ ગયું છે.", (0.0, 0.0, 0.0, 1.0, 0.0, 0.0)),
    (None, (0.0,) * 6),
]


def test_signals(spark):
    assert [tuple(v) for v in values(spark, [t for t, _ in SIGNAL_CASES], X.signals)] == [s for _, s in SIGNAL_CASES]


def test_explanation(spark):
    told = lambda p: values(spark, [SIGNAL_CASES[0][0], SIGNAL_CASES[4][0]], lambda t: X.explanation(X.signals(t), F.lit(p)))
    assert told("Critical") == [
        "Critical priority: Significant financial/unauthorized charge impact, high urgency demand, strict time sensitivity or severe delay detected.",
        "Critical priority: " + fixed.ELEVATED,
    ]
    assert told("Low")[1] == "Low priority: " + fixed.ROUTINE


def test_gate(spark):
    bad = [None, "", "   ", "12345", "!!! ???", "aaaaaaa", "asdf", "qwertyuiop 123", "asdf !!! 77", "😀😀", "test 111111"]
    good = ["hi", " My order is late ", "asdf is what I typed", "aaaaa", "રિફંડ", "x" * 4999 + "y"]
    got = values(spark, [*bad, *good, "a" * 5001, " " * 5001], X.gate)
    assert all(g.message and g.status_code == 400 and g.ticket_text is None for g in got[: len(bad)])
    assert [g.ticket_text for g in got[len(bad) : -2]] == [t.strip() for t in good]
    assert [g.status_code for g in got[-2:]] == [413, 413]


def test_pii(spark):
    got = values(spark, ["mail a.b@c.org now", "call 555-123-4567", "card 4111 1111 1111 1111", "ssn 123-45-6789", "nothing 12"], X.pii)
    assert got[0] == ["Email address detected"] and "Phone number detected" in got[1] and "Credit card sequence detected" in got[2]
    assert "SSN pattern detected" in got[3] and got[4] == []


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("Paid $45.50 twice", "paid <AMOUNT> twice"),
        ("from 10.0.0.1 today", "from <IP> today"),
        ("my order number 12345 is late", "my <<ID>> <<ID>> <<ID>> is late".replace("<<ID>>", "<ID>")),
        ("Hello   there. Thanks for your help!", "hello there."),
        (None, ""),
    ],
)
def test_signature(spark, text, masked):
    assert values(spark, [text], X.signature) == [masked]


def test_languages(spark):
    texts = ["Mera order kahan hai", "my phone", "status update nathi", "मेरा", "plain words"]
    assert values(spark, texts, X.language_by_parts) == ["hinglish", "hinglish", "gujarati", "english", "english"]
    assert values(spark, texts, X.language_by_words)[:2] == ["Hinglish / Romanized Hindi", "English / Other"]
    assert values(spark, texts, X.language_by_words)[3] == "Hindi (Devanagari)"


def test_rule_priority(spark):
    label = lambda t, base="Low", suffix="": values(spark, [t], lambda c: X.rule_priority(c, F.lit(base), F.lit(suffix)))[0]
    assert label("My account was hacked") == "Critical"
    assert label("cancel subscription immediately") == "High"
    assert label("The box came damaged") == "Medium" and label("The box came damaged", "High") == "High"
    assert label("Where is my parcel?", "High") == "Low"
    assert label("Anything. Urgent attention required.", "Low", "Urgent attention required.") == "Medium"


def test_departments_and_ids(spark):
    got = values(spark, ["Billing", " Shipping ", "Unknown", None, ""], X.department)
    assert got == ["Billing Team", "Logistics Team", *["General Support Team"] * 3]
    (number,) = values(spark, ["x"], lambda c: X.reference_number("FB-", c))
    assert len(number) == 9 and number == values(spark, ["x"], lambda c: X.reference_number("FB-", c))[0]


def test_the_gate_makes_its_parts_once_a_row(spark):
    rows = spark.createDataFrame([("  a text  ",)], "t string")
    plan = rows.select(X.gate(F.col("t")).alias("g")).select("g.*")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"[^\p{L}\p{N}]+") == 1 and plan.count(r"(?U)\s+$") == 1
