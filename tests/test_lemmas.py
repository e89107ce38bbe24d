"""Lemmas against suffix detachment word by word."""

import random

from triagelake import fixed
from triagelake.operators import lemmas


def one(word, lexicon, exceptions):
    if word in exceptions:
        found = [f for f in [word, *sorted(exceptions[word])] if f in lexicon]
        return min(found, key=len) if found else word
    detach = lambda xs: [x[: -len(old)] + new for x in xs for old, new in fixed.NOUN_SUFFIXES if x.endswith(old)]
    now = detach([word])
    found = [f for f in [word, *now] if f in lexicon]
    while not found and now:
        now = detach(now)
        found = [f for f in now if f in lexicon]
    return min(found, key=len) if found else word


def test_lemmas_word_by_word(spark):
    rng = random.Random(31)
    endings = ["", "s", "ses", "ves", "xes", "zes", "ches", "shes", "men", "ies", "ss", "sses", "sss", "iess"]
    words = sorted({rng.choice("abc") + rng.choice("abcf") * rng.randint(0, 2) + rng.choice(endings) + rng.choice(endings) for _ in range(900)})
    lexicon = {w for w in words if rng.random() < 0.2} | {rng.choice("abc") + rng.choice(["ab", "f", "man", "y", "x", "s", ""]) for _ in range(20)}
    exceptions = {w: [rng.choice(words), "zzz"] for w in rng.sample(words, 40)}
    made = lambda xs, schema: spark.createDataFrame(xs, schema)
    table = lemmas.lemma_table(made([(w,) for w in words], "word string"), made([(w,) for w in lexicon], "word string"), made([(w, f) for w, fs in exceptions.items() for f in fs], "word string, form string"))
    got = {r.word: r.lemma for r in table.collect()}
    assert got == {w: one(w, lexicon, exceptions) for w in words if one(w, lexicon, exceptions) != w} and len(got) > 50


def test_documents(spark):
    lexicon = spark.createDataFrame([("order",), ("box",), ("child",), ("wife",), ("order",), (None,)], "word string")
    exceptions = spark.createDataFrame([("children", "child"), ("wives", "wife"), ("geese", "goose")], "word string, form string")
    docs = spark.createDataFrame([(1, "My orders, and the children's boxes!", "k"), (1, "My orders, and the children's boxes!", "k"), (2, None, None), (3, "  ", ""), (4, "geese lost wives " * 5000, "x"), (None, "status orders", "")], "doc_id long, text string, word string")
    for limit in (100, 0):
        got = sorted(((r.doc_id, r.words, r.word) for r in lemmas.preprocess(docs, lexicon, exceptions, broadcast=limit).collect()), key=str)
        assert got == sorted([(1, "order child box", "k")] * 2 + [(2, "", None), (3, "", ""), (4, " ".join(["geese lost wife"] * 5000), "x"), (None, "status order", "")], key=str)
    assert lemmas.preprocess(docs.limit(0), lexicon, exceptions).count() == 0
    assert sorted(r.words for r in lemmas.preprocess(docs.where("doc_id = 1"), lexicon.limit(0), exceptions.limit(0)).collect()) == ["orders children boxes"] * 2


def test_words_that_do_not_change_stay_in_their_row(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    docs = frame([(1, "parcels parcel parcels late"), (2, "late"), (3, None)], "id long, text string")
    found = lemmas.preprocess(docs, frame([("parcel",)], "word string"), frame([], "word string, form string"))
    assert {r.id: r.words for r in found.collect()} == {1: "parcel parcel parcel late", 2: "late", 3: ""}
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
