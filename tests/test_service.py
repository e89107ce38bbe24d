"""Files, models and their store, requests, generator, on small frames."""

import csv
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake import fixed
from triagelake.functions import text as X
from triagelake.operators import evaluate, features, ingest, machines, models, store
from triagelake.plans.queries import QUERIES
from triagelake.sources import files
from triagelake.sources import tickets as S

SMALL = "/root/testdata/sf0.001"

TEXTS = [("refund refund my money please", "Refund", "High"), ("parcel parcel never came", "Shipping", "Medium"), ("cannot login to my account, hacked", "Account", "Critical"), ("what is the pricing", "Billing", "Low")]


@pytest.fixture(scope="module")
def rows(spark):
    made = [(i, f"T{i}", f"{TEXTS[i % 4][0]} word{chr(97 + i % 9)}", *TEXTS[i % 4][1:], ("train", "train", "train", "test", "holdout")[(i // 4) % 5]) for i in range(120)]
    return spark.createDataFrame(made, "row_ord long, ticket_id string, ticket_text string, category string, priority string, split string").repartition(3).persist()


def test_json_files(spark, tmp_path):
    path = f"file://{tmp_path}/metrics.json"
    assert files.read_json(spark, path) == {}
    files.write_json(spark, path, {"a": {"b": 1}, "ü": [1, 2]})
    assert json.loads((tmp_path / "metrics.json").read_text()) == {"a": {"b": 1}, "ü": [1, 2]} and (tmp_path / "metrics.json").read_text().startswith('{\n    "a"')
    assert files.merge_json(spark, path, "holdout", {"accuracy": 0.5}) == {"a": {"b": 1}, "ü": [1, 2], "holdout": {"accuracy": 0.5}} == files.read_json(spark, path)
    for text in ("{cut", "[1]", "7", ""):
        files.write_text(spark, path, text)
        assert files.read_json(spark, path) == {}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["metrics.json"]


def test_csv_files_round_trip(spark, tmp_path):
    given = [("1", 'He said "no",\nthen; left', None, "Low", ""), ("2", "  plain ", "Refund", None, "manual")]
    rows = spark.createDataFrame(given, "ticket_id string, ticket_text string, category string, priority string, source string")
    files.write_csv(rows, f"file://{tmp_path}/out")
    read = S.read_csv(spark, f"file://{tmp_path}/out").orderBy("ticket_id").collect()
    assert [tuple(r) for r in read] == [("1", given[0][1], None, "Low", None), given[1]]
    with open(next((tmp_path / "out").glob("*.csv")), newline="") as f:
        assert next(csv.reader(f)) == rows.columns


def test_reports(spark, tmp_path):
    counts = spark.createDataFrame([("a|b", 1), (None, 2)], "name string, n int").orderBy(F.desc("n"))
    text = files.write_report(spark, f"file://{tmp_path}/r.md", {"Counts": counts}, "Report")
    assert text == (tmp_path / "r.md").read_text() == "# Report\n\n## Counts\n\n| name | n |\n| --- | --- |\n|  | 2 |\n| a\\|b | 1 |\n"
    with pytest.raises(ValueError):
        files.markdown(spark.range(11), "x", limit=10)


def test_landing_folder_and_projection(spark, tmp_path):
    for name in ("a.csv", "processed_a.csv", "rejected_b.csv", "c.txt"):
        (tmp_path / name).write_text(f"ticket_id,ticket_text,category,priority,source,created_at\n{name},text,Billing,Low,manual,\n")
    assert [r.ticket_id for r in S.read_landing(spark, f"file://{tmp_path}").collect()] == ["a.csv"]
    assert S.keep_known(spark.range(1).toDF("b"), ("a", "b", "c")).columns == ["b"]


def test_append_first_goes_by_row_order(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "row_ord long, ticket_id string, ticket_text string")
    ingest.append_first(frame([(7, "b", "same"), (3, "z", "same"), (1, "c", "old")]), frame([(1, "a", "same"), (5, "x", "new"), (2, "y", "new")]), f"file://{tmp_path}/out")
    assert {r.ticket_text: r.ticket_id for r in spark.read.parquet(f"file://{tmp_path}/out").collect()} == {"same": "z", "old": "c", "new": "y"}


def vectors_of(made, rows):
    found = made.vectors(rows).orderBy("row_ord")
    return found.collect(), found


@pytest.mark.parametrize("sublinear", [True, False])
def test_features_follow_the_closed_form(rows, sublinear):
    train = rows.where("split = 'train'")
    made = models.Features.fit(train, 60, sublinear=sublinear)
    words = {r.row_ord: r.w for r in rows.select("row_ord", features.words_of(F.col("ticket_text")).alias("w")).collect()}
    terms = {i: [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))] for i, w in words.items()}
    seen = {r.row_ord for r in train.collect()}
    df = {t: sum(t in terms[i] for i in seen) for t in made.terms}
    assert made.idf == pytest.approx([math.log((1 + len(seen)) / (1 + df[t])) + 1 for t in made.terms])
    for r in vectors_of(made, rows)[0]:
        tf = [terms[r.row_ord].count(t) for t in made.terms]
        raw = np.array([((1 + math.log(n)) if sublinear else n) * w if n else 0 for n, w in zip(tf, made.idf, strict=True)])
        assert r.plain.toArray() == pytest.approx(raw / np.linalg.norm(raw))
        assert r.stacked.toArray()[: len(made.terms)] == pytest.approx(r.plain.toArray()) and len(r.stacked) == len(made.terms) + 6
        assert r.stacked.toArray()[-6:].max() == (1.0 if "hacked" in r.ticket_text else 0.75 if "refund" in r.ticket_text else r.stacked.toArray()[-6:].max())


def dense_problem(found, target, folds, seed=42):
    x = np.stack([np.append(r.plain.toArray(), 1) for r in found])
    labels = sorted({r[target] for r in found})
    return x, np.array([labels.index(r[target]) for r in found]), labels


def test_margins_are_the_least_of_all(spark, rows):
    """Every problem's weights are a minimum: the gradient, taken here from dense rows, is next to nothing."""
    made = models.Features.fit(rows, 40)
    found, frame = vectors_of(made, rows)
    x, y, labels = dense_problem(found, "priority", 3)
    fold = np.array([r.f for r in frame.select("row_ord", F.pmod(F.xxhash64("ticket_id", F.lit(42)), F.lit(3)).alias("f")).orderBy("row_ord").collect()])
    model = models.fit(files.written(frame, "v"), "priority", models.Config("s", models.SVM, folds=3), len(made.terms))
    for c in range(len(labels)):
        for f in range(3):
            w, a, b = model.weights[:, c * 3 + f], *model.sigmoids[:, c * 3 + f]
            t = np.where(y == c, 1.0, -1.0)
            use = fold != f
            gap = np.maximum(0, 1 - t[use] * (x[use] @ w))
            first = 2 * np.linalg.norm(x[use].T @ t[use])
            assert np.linalg.norm(w - 2 * x[use].T @ (t[use] * gap)) < 2e-3 * first
            held = ~use
            margins, yes = x[held] @ w, (t[held] > 0)
            target = np.where(yes, (yes.sum() + 1) / (yes.sum() + 2), 1 / ((~yes).sum() + 2))
            p = 1 / (1 + np.exp(a * margins + b))
            assert abs(((target - p) * margins).sum()) < 1e-2 and abs((target - p).sum()) < 1e-2
    scored = model.score(frame).orderBy("row_ord").collect()
    every = np.stack([1 / (1 + np.exp(model.sigmoids[0, k] * (x @ model.weights[:, k]) + model.sigmoids[1, k])) for k in range(3 * len(labels))], 1).reshape(len(x), len(labels), 3)
    assert np.array([r.probability for r in scored]) == pytest.approx((every / every.sum(1, keepdims=True)).mean(2))
    assert [r.plain for r in scored] == [r.plain for r in found] and all(abs(sum(r.probability) - 1) < 1e-6 for r in scored)


def test_summed_in_steps(spark):
    def ones(batches):
        import numpy as np
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([np.array([float(sum(b.num_rows for b in batches))]).tobytes()])], ["total"])

    found = machines.summed(spark.range(1000).repartition(300), ones, ["total"], 300)
    assert found[0].tolist() == [1000.0]


def test_settings_of_the_candidates():
    assert [(c.kind, c.signals, c.balanced, c.trees, c.folds) for c in models.CANDIDATES if c.kind != models.LR] == [
        (models.SVM, False, False, 100, 3), (models.RF, False, False, 100, 5), (models.RF, True, True, 150, 5), (models.SVM, True, True, 100, 3)]
    assert all(c.max_iter == 1000 and c.depth == 30 for c in models.CANDIDATES)
    assert [c.kind for c in models.production(True)] == [models.LR, models.NB, models.RF, models.SVM] and all(c.folds == 5 for c in models.production(True))


def test_benchmark_scores_by_hand(spark, rows):
    configs = (models.Config("bayes", models.NB), models.Config("machine", models.SVM, folds=3), models.Config("forest", models.RF, trees=5, signals=True), models.Config("linear", models.LR, balanced=True))
    got = {(r.model, r.split): r for r in models.benchmark(rows, "category", configs, 60).collect()}
    assert set(got) == {(c.name, s) for c in configs for s in ("test", "holdout")} and all(r.rows == 24 for r in got.values())
    assert all(got[n, s].accuracy == 1.0 for n in ("bayes", "machine", "linear") for s in ("test", "holdout"))
    told = spark.createDataFrame([("m", "a", "a"), ("m", "a", "b"), ("m", "b", "b"), ("m", "c", "b"), ("n", "a", "a")], "model string, y string, p string")
    found = {r.model: (r.accuracy, r.macro_f1, r.weighted_f1, r.rows) for r in evaluate.summary(told, ["model"], "y", "p").collect()}
    assert found == {"m": (0.5, round((2 / 3 + 0.5 + 0) / 3, 4), round((2 / 3 * 2 + 0.5) / 4, 4), 4), "n": (1.0, 1.0, 1.0, 1)}


@pytest.fixture(scope="module")
def predictor(rows):
    return models.train_predictor(rows, (models.Config("forest", models.RF, trees=8), models.Config("bayes", models.NB)), (models.Config("machine", models.SVM, balanced=True, signals=True, folds=3),), 80)


ASKED = [(1, "T1", "My refund, please refund my money"), (2, "T2", None), (3, "T3", "  \t"), (4, "T4", "ok"), (5, "T5", "hacked account login"), (6, "T6", "હેક")]


def test_prediction_records(spark, predictor):
    found = {r.row_ord: r for r in predictor.predict(spark.createDataFrame(ASKED, "row_ord int, ticket_id string, ticket_text string")).collect()}
    for i in (2, 3):
        r = found[i]
        assert (r.status, r.error, r.category, r.priority, r.department, r.confidence) == ("error", models.EMPTY, "Unclassified", "Medium", fixed.DEFAULT_DEPARTMENT, 0.0)
        assert r.category_confidence is None and r.priority_signals is None and r.priority_explanation is None
    assert (found[1].category, found[1].department, found[5].category) == ("Refund", "Refund Team", "Account")
    for i in (1, 4, 5, 6):
        r = found[i]
        assert r.status == "success" and r.error is None and r.confidence == r.category_confidence and 0 < r.priority_confidence <= 100
        assert r.priority_confidence == max(r.priority_distribution.values()) and set(r.priority_distribution) == set(fixed.PRIORITIES)
        assert sum(r.priority_distribution.values()) == pytest.approx(100, abs=0.05) and r.priority_explanation.startswith(r.priority)
    assert found[5].priority_signals.security_risk == found[6].priority_signals.security_risk == 1.0


def test_model_store(spark, rows, predictor, tmp_path):
    asked = spark.createDataFrame(ASKED, "row_ord int, ticket_id string, ticket_text string")
    kept = models.ModelStore(spark, f"file://{tmp_path}/models")
    assert kept.load() is None and {(r.status, r.error) for r in kept.predict(asked).collect()} == {("error", models.MISSING)}
    assert kept.predict(asked).columns == predictor.predict(asked).columns
    kept.save(predictor, "v1")
    assert kept.load() is None
    with pytest.raises(KeyError):
        kept.activate("v7")
    kept.activate("v1")
    models._LOADED.clear()
    found = kept.load()
    assert found is kept.load() and found is not predictor
    want, got = (sorted(map(str, p.predict(asked).collect())) for p in (predictor, found))
    assert want == got and found.metrics["best_category_model"] in ("forest", "bayes")
    folder = kept.registry()["versions"]["v1"]["folder"]
    (tmp_path / "models" / folder / "priority" / "described.json").unlink()
    models._LOADED.clear()
    assert kept.load() is None


def test_gated_retraining(spark, rows, predictor, tmp_path):
    part = lambda s: rows.where(F.col("split") == s)
    told = spark.createDataFrame([("T0", "refund now", "High", 1), ("T1", "", "Low", 1), ("T2", None, "Low", 1), ("T3", "pricing", "Low", 0)], "ticket_id string, ticket_text string, corrected_priority string, validated int")
    kept = models.ModelStore(spark, f"file://{tmp_path}/models")
    quick = models.Config("bayes", models.NB)
    with pytest.raises(ValueError):
        models.retrain(kept, part("train"), part("test"), part("holdout"), told)
    kept.save(predictor, "v1", activate=True)
    first = models.retrain(kept, part("train"), part("test"), part("holdout"), told, config=quick)
    assert first["validated_feedback_samples_used"] == 1 and first["action_taken"] == "Retained candidate in isolation" and kept.registry()["active"] == "v1"
    assert first["promotion_gate_passed"] == (first["candidate_holdout_accuracy"] >= first["production_holdout_accuracy"] and first["candidate_val_accuracy"] >= 0.85)
    assert models.retrain(kept, part("train"), part("test"), part("holdout"), told, True, quick, least=1.1)["promotion_gate_passed"] is False and kept.registry()["active"] == "v1"
    last = models.retrain(kept, part("train"), part("test"), part("holdout"), told, True, quick)
    assert last["promotion_gate_passed"] and kept.registry()["active"] == "v4" and kept.load().priority.config.kind == models.NB and kept.load("v1").priority.config.kind == models.SVM


def test_requests_by_hand(spark):
    tickets = spark.createDataFrame([(1, "TICK-1", "a", "High", 50.0, None, "X", None), (2, "TICK-2", "b", "Low", None, 40.0, "X", 1)], "id int, ticket_id string, ticket_text string, priority string, confidence double, priority_confidence double, department string, assigned_agent_id int")
    bodies = ['{"ticket_id": " TICK-1 ", "corrected_priority": "Low", "validated": true}', '{"ticket_id": "TICK-2", "corrected_priority": "low"}', '{"ticket_id": "TICK-9", "corrected_priority": "Low"}', "[]", None, "{", '{"ticket_id": 7, "corrected_priority": "Low"}']
    asked = spark.createDataFrame(list(enumerate(bodies)), "row_ord int, body string")
    got = {r.row_ord: r for r in store.answer_feedback(asked, tickets).collect()}
    assert [got[i].status_code for i in range(7)] == [201, 400, 404, 400, 400, 400, 400]
    assert (got[0].ticket_id, got[0].original_priority, got[0].original_priority_confidence, got[0].validated, got[0].reviewer, got[0].ticket_text) == ("TICK-1", "High", 50.0, 1, "agent", "a")
    texts = spark.createDataFrame([(i, b) for i, b in enumerate(['{"ticket_text": " My order is late "}', '"x"', '{"ticket_text": ""}', None, '{"ticket_text": "%s"}' % ("a" * 5001)])], "row_ord int, body string")
    assert {r.row_ord: (r.ticket_text, r.status_code) for r in store.ticket_texts(texts).collect()} == {0: ("My order is late", None), 1: (None, 400), 2: (None, 400), 3: (None, 400), 4: (None, 413)}
    agents = spark.createDataFrame([(1, "A", "X", 1), (2, "B", "X", 0)], "id int, name string, department string, is_active int")
    answers = store.answer_assign(spark.createDataFrame([(0, "TICK-1"), (1, "TICK-2"), (2, "TICK-3")], "row_ord int, ticket_id string"), tickets, agents)
    assert {r.row_ord: (r.status_code, r.agent_id) for r in answers.collect()} == {0: (200, 1), 1: (409, None), 2: (404, None)}
    assert {r.ticket_id: r.assigned_agent_id for r in store.reassigned(tickets, answers).collect()} == {"TICK-1": 1, "TICK-2": 1}
    deleted = store.answer_delete(spark.createDataFrame([(0, "TICK-1"), (1, "TICK-1"), (2, " "), (3, "no")], "row_ord int, ticket_id string"), tickets, "row_ord")
    assert {r.row_ord: r.status_code for r in deleted.collect()} == {0: 200, 1: 404, 2: 400, 3: 404}
    assert [r.ticket_id for r in store.without(tickets, deleted).collect()] == ["TICK-2"]


def test_store_migrates_and_starts(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.create(spark, path)
    assert store.next_seq(spark, path, "tickets") == 1
    spark.createDataFrame([(1, "put", 5, "TICK-5")], "seq long, kind string, id long, ticket_id string").write.mode("append").parquet(f"{path}/tickets")  # as an older version wrote it
    store.append(spark.createDataFrame([(2, 6, "TICK-6", "Open", "extra")], "seq long, id long, ticket_id string, status string, unknown string"), path, "tickets")
    now = {r.ticket_id: r.status for r in store.state(spark, path, "tickets", "ticket_id").collect()}
    assert now == {"TICK-5": None, "TICK-6": "Open"} and store.next_seq(spark, path, "tickets") == 3
    asked = spark.createDataFrame([(i, f"T{i}", "text") for i in range(40)], "row_ord long, ticket_id string, ticket_text string")
    first = store.bootstrap(asked, spark.createDataFrame([], store.SCHEMAS["tickets"]), models.unloaded, "row_ord")
    assert sorted(r.id for r in first.collect()) == list(range(25)) and {(r.category, r.confidence, r.category_confidence, r.status) for r in first.collect()} == {("Unclassified", 0.0, 95.0, "Open")}
    assert store.bootstrap(asked, asked, models.unloaded, "row_ord").count() == 0


def test_saved_accuracy():
    shown = [store.saved_accuracy({"m": {"accuracy": a}}, "m") for a in (0.97867, 1, 0, 1.2, -0.1, None, "0.5", True, float("nan"))]
    assert shown == ["97.87%", "100.00%", "0.00%", "—", "—", "—", "—", "—", "—"]
    assert store.saved_accuracy(None, "m") == store.saved_accuracy({"m": 5}, "m") == store.saved_accuracy({}, None) == "—"


def test_generator(spark):
    made = S.generate(spark, 800).collect()
    assert len(made) == 800 and {c: sum(r.category == c for r in made) for c in fixed.CATEGORIES} == dict.fromkeys(fixed.CATEGORIES, 100)
    assert not [r.ticket_text for r in made if "{" in r.ticket_text] and {r.language for r in made} == {"en", "hinglish", "gujarati"}
    assert [r.ticket_id for r in made] != sorted(r.ticket_id for r in made) and len({r.ticket_id for r in made}) == 800
    assert any("PRO-" in r.ticket_text for r in made) and any("192.168." in r.ticket_text for r in made) and any(r.ticket_text.startswith("Hello, ") for r in made)
    assert not [r for r in made if "rgent attention required" in r.ticket_text and r.priority == "Low"]
    own = S.generate(spark, 9, 1, (("A", "text {id}", "Low", "en"), ("B", "other {amount}", "High", "en")))
    assert sorted(r.category for r in own.collect()) == ["A"] * 5 + ["B"] * 4 and S.generate(spark, 0).count() == 0


def test_numbers_of_rows_that_repeat(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["x", None])) for _ in range(30)]
    from triagelake.operators import profile

    got = {r.kind: r.n for r in profile.surplus(spark.createDataFrame(rows, "p string, q string"), ("p", "q")).collect()}
    assert got == {"row": 30 - len(set(rows)), "p": 28, "q": 28}


def test_tasks_do_not_carry_the_weights(spark):
    """What is pickled with a step is as small for many terms as for few; the gradient equals one counted problem by problem."""
    import pyarrow as pa
    from pyspark.serializers import CloudPickleSerializer

    sizes = []
    for terms in (10, 200_000):
        with machines.sent(spark.range(1), np.zeros((terms + 1, 20))) as (there,):
            sizes.append(len(CloudPickleSerializer().dumps(machines.partial(machines._pass, sent_w=there, classes=4, folds=5))))
            spark.sparkContext._pickled_broadcast_vars.clear()
    assert sizes[0] == sizes[1] < 10_000
    rng = np.random.default_rng(5)
    n, terms, classes, folds = 200, 30, 3, 2
    at = [sorted(rng.choice(terms, rng.integers(0, 8), replace=False).tolist()) for _ in range(n)]
    v = [rng.random(len(a)).tolist() for a in at]
    label, fold, weight = rng.integers(0, classes, n), rng.integers(0, folds, n), rng.random(n)
    w = rng.normal(size=(terms + 1, classes * folds))

    class There:
        value = w

    batch = pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(v, pa.list_(pa.float64())), pa.array(label.astype(np.int32)), pa.array(fold.astype(np.int32)), pa.array(weight)], ["at", "v", "label", "fold", "weight"])
    found = next(machines._pass(iter([batch]), There, classes, folds))
    gradient = np.frombuffer(found.column("gradient")[0].as_py()).reshape(w.shape)
    wanted, loss = np.zeros_like(w), np.zeros(classes * folds)
    for i in range(n):
        for p in range(classes * folds):
            y, x = (1 if label[i] == p // folds else -1), np.zeros(terms + 1)
            x[at[i]], x[-1] = v[i], 1
            gap = max(0, 1 - y * (x @ w[:, p]))
            if fold[i] != p % folds:
                wanted[:, p] += -2 * weight[i] * y * gap * x
                loss[p] += weight[i] * gap * gap
    assert np.allclose(gradient, wanted) and np.allclose(np.frombuffer(found.column("loss")[0].as_py()), loss)


def test_equal_rows_are_one_for_a_model(rows, monkeypatch):
    """Three copies of every row, with ids of their own: what is fitted is no more rows, and they weigh as much."""
    seen = []
    monkeypatch.setattr(machines, "fit_margins", lambda r, size, classes, folds, parts, **_: (seen.append(r.agg(F.count("*"), F.sum("n")).first()), np.zeros((size + 1, classes * folds)))[1])
    copies = rows.withColumn("ticket_id", F.explode(F.array(*[F.concat("ticket_id", F.lit(f"-{i}")) for i in range(3)])))
    for frame in (rows, copies):
        made, vectors, kinds = models.prepared(frame, (models.Config("s", models.SVM),), 60)
        models.fit(vectors, "priority", models.Config("s", models.SVM, folds=1), len(made.terms), kinds=kinds)
    assert seen[0][0] == seen[1][0] < seen[0][1] == rows.count() and seen[1][1] == 3 * seen[0][1]


def test_weights_and_bayes_are_made_in_rows(spark):
    """No (document, term) pair is shuffled or sorted, and a larger table has more parts."""
    plan = QUERIES["tfidf_weights"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    plan = QUERIES["nb_predict"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(files, "DEALT", 100)
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert S.raw_tickets(spark, SMALL).rdd.getNumPartitions() == -(-orders.count() // 100) > 4


def test_equal_texts_are_scored_once(rows, predictor, monkeypatch):
    """Three copies of every row: no more vectors are made, and each copy has its row's record."""
    seen, real = [], models.Features.vectors
    monkeypatch.setattr(models.Features, "vectors", lambda self, r: (seen.append(r.count()), real(self, r))[1])
    copies = rows.withColumn("copy", F.explode(F.array(*map(F.lit, range(3)))))
    found = [predictor.predict(f.select("row_ord", "ticket_id", "ticket_text")).groupBy("row_ord").agg(F.count("*").alias("n"), F.countDistinct("priority", "category", "confidence").alias("k")).collect() for f in (rows, copies)]
    assert seen[0] == seen[1] <= rows.count() and all(r.n == 3 and r.k == 1 for r in found[1]) and len(found[0]) == len(found[1]) == rows.count()


def test_languages_and_predictions_of_a_group_are_counted_in_one_pass(spark):
    """No row is multiplied for the values that are counted; nulls are none of them, and a value that is not listed is told."""
    rows = spark.createDataFrame([(1, "en", "a", "a"), (1, "hi", "a", "a"), (1, "hi", "a", "a"), (2, "en", "a", "a"), (2, "gu", "b", "a"), (2, "hi", None, "a"), (3, "en", "a", "a"), (4, None, "b", "b"), (4, "en", None, "b"), (4, "gu", None, "b")], "g long, lang string, p string, e string")
    told = evaluate.by_language(rows, ("g",), "p", "e", ("en", "gu", "hi"), ("a", "b"))
    assert sorted(map(tuple, told.collect())) == [(1, 2, True, True), (2, 3, False, False), (4, 2, True, True)]
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "SortAggregate" not in plan
    with pytest.raises(Exception, match="unlisted p: b"):
        evaluate.by_language(rows, ("g",), "p", "e", ("en", "gu", "hi"), ("a",)).collect()


def test_weights_are_made_once_for_a_prediction(spark):
    """Rows without a known term go without a condition that would make the weights again below them."""
    docs = spark.createDataFrame([(1, ["aa", "bb"]), (2, ["bb", "bb"]), (3, ["zz"]), (4, [])], "row_ord long, _words array<string>")
    weighted = models.Features(["aa", "bb"], [1.0, 2.0]).weighted(docs)
    priors = spark.createDataFrame([("x", math.log(0.5)), ("y", math.log(0.5))], "label string, prior double")
    likelihood = spark.createDataFrame([("x", "aa", -0.1), ("x", "bb", -2.0), ("y", "aa", -2.0), ("y", "bb", -0.1)], "label string, term string, logp double")
    found = features.bayes_predict(weighted, ["aa", "bb"], priors, likelihood)
    assert sorted(map(tuple, found.collect())) == [(1, "y"), (2, "y")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("UDF(") == 1


def test_shapes_have_the_words_and_signals_of_texts(spark):
    """Digits that patterns name stay as they are, longer runs are alike; blankness stays too."""
    for pattern in (p for rules in fixed.SIGNALS.values() for p, _ in rules):
        for named in re.finditer("[0-9]+", pattern):
            assert pattern.startswith(r"\b(") and pattern[named.start() - 1] in "(|" and re.match(r"\\s|[a-z]", pattern[named.end() :]) and len(named.group()) < X.LONG_RUN
    chance = random.Random(4)
    pieces = ["24 hours", "2fa failed", "500 internal", "delayed by 2 days", "late by 123456 days", "delayed for 70000 weeks", "refund", "www.a.org/", "<b", ">", "hours", "fa failed", "internal", "error code", "ERR_", "-", " ", "\n", "હેક", "٣٤٥٦٧"]
    number = lambda: "".join(chance.choice("0245") for _ in range(chance.randint(1, 7)))
    texts = [None, "", "  ", "1924 hours", "12342fa failed", "9500 internal", "0000 24 hours", *("".join(chance.choice([number(), *chance.sample(pieces, 2)]) + chance.choice(["", " "]) for _ in range(6)) for _ in range(400))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("s", X.shape(F.col("t")))
    of = lambda c: F.struct(X.signals(F.col(c)), features.words_of(F.col(c)), features.words_of(F.col(c), True), F.coalesce(X.strip(F.col(c)) == "", F.lit(True)))
    assert rows.where(of("t") != of("s")).count() == 0 < rows.where("t <> s").count()
    assert [r.s for r in rows.where("i in (0, 3)").orderBy("i").collect()] == ["", "0000 hours"]
    named = spark.createDataFrame([(n,) for n in ("Refund", " rEFUND ", "technical support", "re fund", "", None)], "n string")
    assert [r.n for r in named.select(X.title(F.col("n"), fixed.CATEGORIES).alias("n")).collect()] == ["Refund", "Refund", "Technical Support", None, None, None]


def test_texts_are_read_once_a_shape(spark, rows, predictor, monkeypatch):
    """Texts that differ in a long number: training and prediction make words, signals and records of one, and every row has its own answer."""
    seen, real = {}, files.written

    def counted(frame, tag):
        out = real(frame, tag)
        seen[tag] = out.count()
        return out

    monkeypatch.setattr(files, "written", counted)
    asked = spark.createDataFrame([(i, f"T{i}", f"Refund my order {10_000 + i} please", "Refund", "High", "train") for i in range(120)], rows.schema)
    found = predictor.predict(asked.select("row_ord", "ticket_id", "ticket_text")).collect()
    assert set(seen.values()) == {1} and sorted(r.row_ord for r in found) == list(range(120)) and {(r.status, r.priority_signals.financial_impact) for r in found} == {("success", 0.75)}
    seen.clear()
    made, slim, kinds = models.prepared(asked.unionByName(rows), (models.Config("s", models.SVM, signals=True),), 60)
    assert slim.count() == 240 == seen.pop("rows") and "words" not in seen and kinds.count() <= 37 and max(seen.values()) <= 37
    plain = models.Features.fit(asked.unionByName(rows).where("split = 'train'"), 60)
    assert plain.terms == made.terms and plain.idf == made.idf


def test_predicted_rows_meet_no_pattern(spark):
    """What predict_tickets checks of a text it makes once a shape: no signal's pattern is left for the pass over the rows."""
    plan = QUERIES["predict_tickets"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_replace" in plan
