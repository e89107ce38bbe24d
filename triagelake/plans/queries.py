"""The registered queries: every operator over whole input tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X
from ..operators import constraints, evaluate, features, ingest, lemmas, models, prepare, profile, rules, sketches, store
from ..sources import files
from ..sources import tickets as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Terms that the TF-IDF features keep.
VOCABULARY = 10_000


def query(f: Query) -> Query:
    """Register ``f`` under its name."""
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return files.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang"), "doc_id")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return prepare.keep_first(prepare.clean_rows(S.raw_tickets(spark, d)))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    rows = S.tickets(spark, d)
    return rows.withColumn("predicted", X.rule_priority(F.col("ticket_text"), F.lit("Medium"), F.lit("")))


@query
def dept_priority_counts(spark, d):
    return S.tickets(spark, d).groupBy("department", "priority").agg(F.count("*").alias("n"), F.round(F.avg(X.signal(F.col("ticket_text"), "urgency")), 6).alias("mean_urgency"))


@query
def clean_text_docs(spark, d):
    return _documents(spark, d).select("doc_id", X.clean(F.col("text")).alias("cleaned"))


@query
def clean_html_pages(spark, d):
    return files.spread(spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", "html"), "page_id").select("page_id", X.clean(F.concat_ws(" ", "url", "html")).alias("cleaned"))


@query
def preprocess_docs(spark, d):
    return _documents(spark, d).select("doc_id", X.preprocess(F.col("text")).alias("words"))


#: Nouns that no suffix rule brings back.
IRREGULAR = (("children", "child"), ("feet", "foot"), ("mice", "mouse"), ("people", "person"), ("teeth", "tooth"), ("geese", "goose"), ("data", "datum"), ("indices", "index"), ("wives", "wife"), ("lives", "life"))


@query
def lemmas_docs(spark, d):
    """Preprocessed documents with noun lemmas; the lexicon is the words of all conversations."""
    said = spark.read.parquet(f"{d}/conversations.parquet").select(F.explode(X.tokens(X.clean(F.col("text")))).alias("word")).distinct()
    exceptions = spark.createDataFrame(IRREGULAR, "word string, form string")
    return lemmas.preprocess(_documents(spark, d).select("doc_id", "text"), said, exceptions).select("doc_id", "words")


@query
def word_stats(spark, d):
    return _documents(spark, d).select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_len"))


@query
def length_stats(spark, d):
    return profile.length_stats(S.tickets(spark, d), "ticket_text")


@query
def length_buckets(spark, d):
    return profile.length_buckets(S.tickets(spark, d), "ticket_text")


@query
def vocab_ttr(spark, d):
    return profile.vocabulary(_documents(spark, d), "text")


@query
def top_tokens_by_lang(spark, d):
    rows = _documents(spark, d).select("lang", F.explode(X.tokens(X.clean(F.col("text")))).alias("term"))
    return profile.top_per_group(rows, "lang", "term", 8)


@query
def top_words_by_priority(spark, d):
    rows = S.tickets(spark, d).select("priority", F.explode(profile.ngrams(F.col("ticket_text"), 1)).alias("term"))
    return profile.top_per_group(rows, "priority", "term", 10)


@query
def bigrams_by_priority(spark, d):
    rows = S.tickets(spark, d).select("priority", F.explode(profile.ngrams(F.col("ticket_text"), 2)).alias("term"))
    return profile.top_per_group(rows, "priority", "term", 10)


@query
def priority_signals(spark, d):
    return S.tickets(spark, d).select("ticket_id", *[X.signal(F.col("ticket_text"), s).alias(s) for s in fixed.SIGNALS])


@query
def signals_by_rules(spark, d):
    """The six signals by a table of rules and its index."""
    return rules.signal_scores(S.tickets(spark, d).select("ticket_id", "ticket_text"), rules.rule_table(spark, fixed.SIGNALS), "ticket_id", tuple(fixed.SIGNALS))


@query
def signal_explanation(spark, d):
    rows = S.tickets(spark, d).select("ticket_id", "priority", X.signals(F.col("ticket_text")).alias("s"))
    return rows.select("ticket_id", X.explanation(F.col("s"), F.col("priority")).alias("explanation"))


@query
def signal_bands(spark, d):
    rows = S.tickets(spark, d).select(X.signal(F.col("ticket_text"), "security_risk").alias("s"))
    return rows.groupBy(X.band(F.col("s")).alias("band")).agg(F.count("*").alias("n"))


@query
def rule_priority(spark, d):
    text = F.col("ticket_text")
    suffix = F.when(text.endswith("Urgent attention required."), "Urgent attention required.").otherwise("")
    return S.tickets(spark, d).select("ticket_id", X.rule_priority(text, F.col("priority"), suffix).alias("label"))


@query
def route_department(spark, d):
    return S.raw_tickets(spark, d).select("ticket_id", X.department(F.initcap("category")).alias("department"))


@query
def ticket_gate(spark, d):
    return S.incoming(spark, d).select("row_ord", X.gate(F.col("ticket_text")).alias("g")).select("row_ord", "g.*")


@query
def pii_scan(spark, d):
    rows = _documents(spark, d).select("doc_id", X.pii(F.col("text")).alias("found"))
    return rows.where(F.size("found") > 0).select("doc_id", F.concat_ws(", ", "found").alias("found"))


@query
def validate_incoming(spark, d):
    rows = ingest.validate(S.incoming(spark, d))
    return rows.select("row_ord", F.concat_ws("; ", "reasons").alias("rejection_reason"))


@query
def reject_reasons(spark, d):
    rows = ingest.validate(S.incoming(spark, d)).select(F.explode("reasons").alias("r"))
    return rows.groupBy(F.regexp_replace("r", r"[ ]?['(:].*", "").alias("reason")).agg(F.count("*").alias("n"))


@query
def quality_report(spark, d):
    return profile.gaps(S.raw_tickets(spark, d), ("ticket_id", "ticket_text", "category", "priority", "source"))


@query
def ingest_fold(spark, d):
    rows = ingest.accept(S.incoming(spark, d).where("status <> 'F'"), S.raw_tickets(spark, d).where("status = 'F'"))
    return rows.select("row_ord", "validation_status", "rejection_reason")


@query
def clean_dataset(spark, d):
    return prepare.clean_rows(S.raw_tickets(spark, d)).select("row_ord", "ticket_text", "category", "priority", "source")


@query
def exact_dedup(spark, d):
    return _dense(spark, d).select("row_ord", "ticket_text", "category")


@query
def sequential_ids(spark, d):
    return prepare.numbered(_dense(spark, d)).select("row_ord", "ticket_id")


@query
def near_dup_templates(spark, d):
    rows = S.tickets(spark, d).select(X.audit_signature(F.col("ticket_text")).alias("t"))
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("t").alias("templates")).withColumn("near_duplicates", F.col("rows") - F.col("templates"))


@query
def sketched_profile(spark, d):
    """By source: texts and templates, counted, and whether sketches made by source and day and merged tell them and the medians."""
    rows = S.tickets(spark, d)
    kept = files.written(sketches.sketch(rows.withColumn("day", F.to_date("created_at")), "source", "day"), "sketches")
    return sketches.checked(rows, kept, "source")


@query
def template_signature(spark, d):
    return S.tickets(spark, d).select("ticket_id", X.signature(F.col("ticket_text")).alias("pattern"))


@query
def audit_signature_docs(spark, d):
    return S.tickets(spark, d).select("ticket_id", X.audit_signature(F.col("ticket_text")).alias("pattern"))


@query
def group_split(spark, d):
    return prepare.pattern_splits(_dense(spark, d))


@query
def split_sizes(spark, d):
    return prepare.with_split(_dense(spark, d)).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("category").alias("categories"))


@query
def split_overlap(spark, d):
    """Patterns and raw texts that train and test share: by the split of patterns, which keeps them apart, and by a split of rows."""
    dense = files.written(prepare.with_pattern(_dense(spark, d)).select("row_ord", "ticket_text", "category", "pattern"), "patterns")
    rows = S.tickets(spark, d).select("ticket_text", F.when(F.col("row_ord") % 10 < 7, "train").otherwise("test").alias("split"))
    found = None
    for kind, frame in (("pattern", prepare.with_split(dense)), ("row", rows)):
        shared = prepare.split_overlap(frame).select(F.lit(kind).alias("kind"), "*")
        found = shared if found is None else found.unionByName(shared)
    return found


@query
def dataset_version(spark, d):
    raw, dense = S.raw_tickets(spark, d), _dense(spark, d)
    return prepare.version_summary(raw, dense, prepare.with_split(dense))


@query
def pairwise_leakage(spark, d):
    rows = S.raw_tickets(spark, d, dealt=False).select(F.concat(F.lit("set"), (F.col("row_ord") % 3).cast("string")).alias("set_name"), "ticket_text")
    return prepare.pair_overlaps(rows)


@query
def benchmark_leakage(spark, d):
    """Documents that share a window of 13 words, or a whole shorter passage, with a benchmark item, wherever it stands."""
    return prepare.shared_passages(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))


@query
def category_counts(spark, d):
    return S.tickets(spark, d, dealt=False).groupBy("category").agg(F.count("*").alias("n"))


@query
def priority_share(spark, d):
    return profile.shares(S.tickets(spark, d, dealt=False), "priority")


@query
def cat_pri_crosstab(spark, d):
    return profile.crosstab(S.tickets(spark, d, dealt=False), "category", "priority", fixed.PRIORITIES)


@query
def crosstab_margins(spark, d):
    return profile.margins(S.tickets(spark, d, dealt=False), "category", "priority")


@query
def zero_filled_grid(spark, d):
    return profile.grid(S.tickets(spark, d, dealt=False), "category", fixed.CATEGORIES, "priority", fixed.PRIORITIES)


@query
def keyword_profile(spark, d):
    return profile.keyword_profile(S.tickets(spark, d), "ticket_text")


@query
def dominant_priority(spark, d):
    return S.tickets(spark, d, dealt=False).groupBy("category").agg(F.mode("priority", deterministic=True).alias("priority"))


@query
def lang_mix_a(spark, d):
    return S.tickets(spark, d).groupBy(X.language_by_parts(F.col("ticket_text")).alias("lang")).agg(F.count("*").alias("n"))


@query
def lang_mix_b(spark, d):
    rows = S.tickets(spark, d).withColumn("lang", X.language_by_words(F.col("ticket_text")))
    return profile.margins(rows, "lang", "priority")


@query
def stratification_drift(spark, d):
    return profile.drift(prepare.with_split(_dense(spark, d)), "category")


@query
def longest_ticket(spark, d):
    return profile.extremes(S.tickets(spark, d, dealt=False), "ticket_text", "row_ord")


@query
def null_profile(spark, d):
    rows = S.raw_tickets(spark, d, dealt=False)
    return rows.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in S.RAW_COLUMNS])


@query
def sample_heads(spark, d):
    rank = F.row_number().over(Window.partitionBy("priority").orderBy("row_ord"))
    return S.tickets(spark, d).withColumn("rank", rank).where("rank <= 4").select("priority", "rank", "ticket_text")


@query
def invalid_values_except(spark, d):
    return S.raw_tickets(spark, d, dealt=False).select("category").subtract(spark.createDataFrame([(c,) for c in fixed.CATEGORIES], "category string"))


@query
def union_ragged(spark, d):
    a = S.tickets(spark, d).select("ticket_id", "ticket_text", "department")
    b = S.incoming(spark, d).select("ticket_id", "ticket_text", "source")
    return a.unionByName(b, allowMissingColumns=True)


@query
def accuracy(spark, d):
    return evaluate.accuracy(_judged(spark, d), "priority", "predicted")


@query
def per_class_prf(spark, d):
    return evaluate.per_class(_judged(spark, d), "priority", "predicted")


@query
def macro_weighted(spark, d):
    return evaluate.averages(_judged(spark, d), "priority", "predicted")


@query
def classification_report(spark, d):
    return evaluate.report(_judged(spark, d), "priority", "predicted")


@query
def confusion_matrix(spark, d):
    return profile.grid(_judged(spark, d), "priority", fixed.PRIORITIES, "predicted", fixed.PRIORITIES)


@query
def misclassified_top(spark, d):
    rows = evaluate.misclassified(_judged(spark, d), "priority", "predicted", "row_ord")
    return rows.select("row_ord", "priority", "predicted", F.replace(F.substring("ticket_text", 1, 80), F.lit("|"), F.lit("\\|")).alias("ticket_text"))


@query
def group_consistency(spark, d):
    rows = _judged(spark, d).withColumn("g", F.floor(F.col("row_ord") / 3))
    return evaluate.consistency(rows, "g", "predicted", "priority")


@query
def consistency_score(spark, d):
    return evaluate.consistency_score(group_consistency(spark, d))


@query
def best_model(spark, d):
    """For priority and category the best of three rules each."""
    low = X.rule_priority(F.col("ticket_text"), F.lit("Low"), F.lit(""))
    worded = F.when(F.col("ticket_text").contains("refund"), "Refund").when(F.col("ticket_text").contains("order"), "Shipping").otherwise("Account")
    rows = _judged(spark, d).withColumns({"low": low, "always": F.lit("Medium"), "worded": worded, "billing": F.lit("Billing"), "account": F.lit("Account")})
    named = [("priority", m) for m in ("low", "predicted", "always")] + [("category", m) for m in ("billing", "worded", "account")]
    one = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(m).alias("model"), F.lit(i).alias("ord"), (F.col(t) == F.col(m)).alias("hit")) for i, (t, m) in enumerate(named)])).alias("x")
    scored = rows.select(one).select("x.*").groupBy("target", "model", "ord").agg(F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))
    return evaluate.best(scored, "target", "accuracy", "ord")


@query
def promotion_gate(spark, d):
    """Whether rules may replace the production model, which calls everything Medium, by held-out and validation rows."""
    rows, even = _judged(spark, d), F.col("row_ord") % 2 == 0
    right = lambda c: (F.col("priority") == c).cast("double")
    out = rows.agg(
        F.avg(F.when(even, right(F.col("predicted")))).alias("holdout"), F.avg(F.when(even, right(F.lit("Medium")))).alias("production"), F.avg(F.when(~even, right(F.col("predicted")))).alias("validation")
    )
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns], evaluate.promotion(F.col("holdout"), F.col("production"), F.col("validation")).alias("promote"))


@query
def class_weights(spark, d):
    return evaluate.balanced_weights(S.tickets(spark, d, dealt=False), "priority")


@query
def softmax_conf(spark, d):
    margins = {name: X.signal(F.col("ticket_text"), name) for name in fixed.SIGNALS}
    return S.tickets(spark, d).select("ticket_id", F.explode(evaluate.softmax(margins)).alias("name", "confidence"))


@query
def conversation_latest(spark, d):
    return store.latest(spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query
def tickets_with_agent(spark, d):
    return store.with_agent(S.store_tickets(spark, d), S.agents(spark)).select("ticket_id", "agent")


@query
def recent_tickets(spark, d):
    return store.recent(S.store_tickets(spark, d), S.agents(spark)).select("id", "ticket_id", "agent")


@query
def feedback_join(spark, d):
    return store.feedback_with_ticket(S.feedback(spark, d), S.store_tickets(spark, d)).select("feedback_id", "ticket_text", "original_priority", "original_priority_confidence", "corrected_priority", "validated")


@query
def feedback_stats(spark, d):
    return store.feedback_stats(S.feedback(spark, d))


@query
def feedback_status(spark, d):
    label = F.when(F.col("validated") == 1, "Validated").otherwise("Pending Review").alias("label")
    return S.feedback(spark, d).groupBy(label, "corrected_priority").agg(F.count("*").alias("n"))


@query
def assign_agent(spark, d):
    return store.assign(S.store_tickets(spark, d), S.agents(spark)).select("ticket_id", "agent_id", "status")


@query
def reassign_conflicts(spark, d):
    return store.assign(S.store_tickets(spark, d), S.agents(spark)).groupBy("department", "status").agg(F.count("*").alias("n"))


@query
def latest_state(spark, d):
    return store.latest(S.feedback(spark, d).select("ticket_id", "id", "feedback_id", "corrected_priority", "validated"), "ticket_id", "id")


@query
def insert_or_ignore(spark, d):
    """Tickets of one source, then of the incoming ones each new id's first row; incoming ids repeat."""
    old = S.tickets(spark, d).where("source = 'manual'").select("ticket_id", "ticket_text", "row_ord")
    return store.insert_or_ignore(old, S.incoming(spark, d).select("ticket_id", "ticket_text", "row_ord"), ["ticket_id"], "row_ord")


@query
def store_violations(spark, d):
    """What the store demands and incoming tickets miss, a third of all tickets being there already."""
    key = F.col("row_ord")
    there = S.store_tickets(spark, d).where("id % 3 = 0")
    new = S.incoming(spark, d).select(
        key.alias("seq"), F.when(key % 10 < 6, key + 1).otherwise(key).alias("id"), "ticket_id", "ticket_text", "category", "priority", X.department(F.col("category")).alias("department"),
        F.when(key % 31 != 0, F.lit(0.5)).alias("confidence"), F.when(key % 4 != 0, key % 23 + 1).alias("assigned_agent_id"),
    )
    told = constraints.violations(new, "tickets", {"tickets": there, "agents": S.agents(spark)}, keep=("ticket_id",))
    return told.where("violation is not null").select("seq", "ticket_id", "violation")


@query
def dashboard(spark, d):
    return store.dashboard(S.store_tickets(spark, d), S.feedback(spark, d))


def _weights(spark: SparkSession, d: str, size: int, sublinear: bool, letters: bool) -> DataFrame:
    docs = S.tickets(spark, d).select("ticket_id", features.words_of(F.col("ticket_text"), letters).alias("_words"))
    docs = files.written(docs, "words")
    made = models.Features.fit(docs, size, sublinear, letters)
    return made.long(made.weighted(docs)).select("ticket_id", "term", F.round("weight", 6).alias("weight"))


@query
def tfidf_weights(spark, d):
    return _weights(spark, d, VOCABULARY, True, False)


@query
def tfidf_baseline(spark, d):
    return _weights(spark, d, 5000, False, True)


@query
def tfidf_demo(spark, d):
    return _weights(spark, d, 10, False, True)


def _bayes(rows: DataFrame) -> tuple[models.Features, DataFrame, DataFrame, DataFrame]:
    """(features, ``rows`` weighted, priors, likelihoods) of the category of tickets; three in four have the label that they are learnt from."""
    rows = files.written(rows.withColumns({"_words": features.words_of(F.col("ticket_text")), "label": F.when(F.col("row_ord") % 4 != 0, F.col("category"))}).drop("ticket_text"), "words")
    train = rows.where("label is not null")
    made = models.Features.fit(train, VOCABULARY)
    weighted = made.weighted(rows)
    return made, weighted, *features.bayes_train(made.long(weighted.where("label is not null").select("label", "_at", "_w")), train)


def _predicted(rows: DataFrame, unseen: bool = False) -> DataFrame:
    """``rows`` (row_ord, category, ticket_text, ...) or the unseen ones with the prediction of the predictor that has learnt from three in four."""
    made, weighted, priors, likelihood = _bayes(rows)
    return features.bayes_predict((weighted.where("label is null") if unseen else weighted).drop("label"), made.terms, priors, likelihood)


@query
def nb_train(spark, d):
    return _bayes(S.tickets(spark, d).select("row_ord", "category", "ticket_text"))[3].select("label", "term", F.round("logp", 6).alias("logp"))


@query
def nb_predict(spark, d):
    return _predicted(S.tickets(spark, d).select("ticket_id", "row_ord", "category", "ticket_text"), True).select("ticket_id", "prediction")


def _split(spark: SparkSession, d: str) -> DataFrame:
    """Tickets with a split by hash: seven tenths to train on, two for testing, one held out."""
    part = F.pmod(F.xxhash64("row_ord"), F.lit(10))
    return S.tickets(spark, d).withColumn("split", F.when(part < 7, "train").when(part < 9, "test").otherwise("holdout"))


@query
def lr_predict(spark, d):
    return models.fit_predict(_split(spark, d), "category", models.Config(models.LR, models.LR), VOCABULARY)


@query
def rf_predict(spark, d):
    return models.fit_predict(_split(spark, d), "priority", models.Config(models.RF, models.RF, balanced=True, signals=True, trees=150), VOCABULARY)


@query
def svm_platt_predict(spark, d):
    return models.fit_predict(_split(spark, d), "priority", models.Config(models.SVM, models.SVM, balanced=True), VOCABULARY)


@query
def model_benchmark(spark, d):
    """The six candidates for priority on both evaluation sets."""
    return models.benchmark(_split(spark, d), "priority", models.CANDIDATES, VOCABULARY)


@query
def category_models(spark, d):
    """The four models for category on both evaluation sets."""
    return models.benchmark(_split(spark, d), "category", models.production(False), VOCABULARY)


@query
def predict_tickets(spark, d):
    """Prediction records of all raw tickets, null and blank ones included, by a stored and reloaded predictor."""
    light = (models.Config(models.LR, models.LR),), (models.Config(models.SVM, models.SVM, balanced=True, signals=True, folds=3),)
    store = models.ModelStore(spark, f"{files.scratch(spark, 'models')}")
    store.save(models.train_predictor(_split(spark, d), *light, size=VOCABULARY), "v1", activate=True)
    raw = S.raw_tickets(spark, d).select("row_ord", "ticket_id", "ticket_text")
    # What the texts' own signals explain, for each priority: made anew from the texts, once a shape.
    explained = lambda s: F.array(*[X.explanation(s, F.lit(p)) for p in fixed.PRIORITIES])
    kind_of, kinds = features.by_shape(raw, lambda t: X.bound(X.signals(t), explained))
    rows = store.predict(raw).withColumn("_shape", X.shape(F.col("ticket_text"))).join(kind_of, "_shape").join(kinds, "kind")
    signals = [F.col("priority_signals")[s].alias(s) for s in fixed.SIGNALS]
    routed = X.department(F.when(F.col("status") == "success", F.col("category"))) == F.col("department")
    known = F.col("category").isin(*fixed.CATEGORIES) & F.col("priority").isin(*fixed.PRIORITIES)
    sure = (F.col("confidence") == F.col("category_confidence")) & F.col("confidence").between(0, 100) & F.col("priority_confidence").between(0, 100)
    told = F.col("priority_explanation") == F.get("made", F.array_position(F.array(*map(F.lit, fixed.PRIORITIES)), F.col("priority")).cast("int") - 1)
    return rows.select("row_ord", "status", "error", *signals, F.when(F.col("status") == "success", known & sure & told).alias("sound"), routed.alias("routed"))


@query
def retrain_gate(spark, d):
    """The decision on a priority candidate that has learnt from validated feedback."""
    rows = _split(spark, d)
    store = models.ModelStore(spark, f"{files.scratch(spark, 'models')}")
    store.save(models.train_predictor(rows, (models.Config(models.LR, models.LR),), (models.Config(models.LR, models.LR, balanced=True),), VOCABULARY), "v1", activate=True)
    told = S.feedback(spark, d).select("ticket_id", "corrected_priority", "validated").join(rows.select("ticket_id", "ticket_text"), "ticket_id")
    part = lambda s: rows.where(F.col("split") == s)
    decision = models.retrain(store, part("train"), part("test"), part("holdout"), told, promote=True)
    active = store.registry()["active"]
    return spark.createDataFrame([(k, str(v)) for k, v in [*decision.items(), ("active", active)]], "name string, value string")


@query
def generated_tickets(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    return S.generate(spark, n)


from . import service  # noqa: E402, F401  registers its queries
