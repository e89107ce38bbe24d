"""Registered queries over requests, listings, the dashboard and small checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X
from ..operators import evaluate, ingest, prepare, profile, reports, store
from ..sources import files
from ..sources import tickets as S
from ..streaming.landing import ingest_stream
from .queries import _dense, _judged, _predicted, query

#: Saved metrics as a training run leaves them; the best model for priority has none.
METRICS = {"best_category_model": "Logistic Regression", "category_metrics": {"Logistic Regression": {"accuracy": 0.9787}}, "best_priority_model": "Naive Bayes", "priority_metrics": {}}


@query
def request_texts(spark, d):
    """The ticket texts of request bodies, through the gate."""
    return store.ticket_texts(S.ticket_requests(spark, d)).select("row_ord", "ticket_text", "message", "status_code")


@query
def feedback_answers(spark, d):
    """Answers to requests with corrected priorities, and the feedback that they make."""
    return store.answer_feedback(S.feedback_requests(spark, d), S.store_tickets(spark, d)).select(
        "row_ord", "ticket_id", "corrected_priority", "reviewer", "validated", "original_priority", "original_priority_confidence", "status_code", "message"
    )


@query
def validation_answers(spark, d):
    """Answers to requests that flag feedback."""
    return store.answer_validation(S.validation_requests(spark, d), S.feedback(spark, d)).select("row_ord", "feedback_id", "validated", "status_code", "message")


@query
def feedback_after_validation(spark, d):
    """All feedback with the flags that these requests leave."""
    told = S.feedback(spark, d)
    return store.flagged(told, store.answer_validation(S.validation_requests(spark, d), told), "row_ord").select("feedback_id", "ticket_id", "corrected_priority", "validated")


@query
def delete_answers(spark, d):
    """Answers to requests that delete tickets."""
    return store.answer_delete(_departing(spark, d), S.store_tickets(spark, d), "row_ord").select("row_ord", "status_code", "message")


def _departing(spark, d):
    """Requests for the tickets of one team, beside all blank and unknown ids."""
    team = S.store_tickets(spark, d).where("department = 'Refund Team'").select("ticket_id")
    requests = S.id_requests(spark, d)
    odd = requests.where("trim(ticket_id) = '' or ticket_id like 'GONE-%'")
    return requests.join(team, "ticket_id", "left_semi").unionByName(odd)


@query
def delete_keeps_feedback(spark, d):
    """What deletion leaves: tickets, all feedback, and feedback whose ticket is gone."""
    tickets, told = S.store_tickets(spark, d), S.feedback(spark, d)
    left = store.without(tickets, store.answer_delete(_departing(spark, d), tickets, "row_ord"))
    kept = told.join(left.select("ticket_id", F.lit(1).alias("there")), "ticket_id", "left").join(tickets.select("ticket_id", F.lit(1).alias("was")), "ticket_id", "left")
    counts = kept.agg(F.count("*").alias("feedback"), F.count_if(F.col("was").isNotNull() & F.col("there").isNull()).alias("orphans"))
    return left.agg(F.count("*").alias("tickets")).crossJoin(counts)  # single rows


@query
def assign_answers(spark, d):
    """Answers to requests that assign an agent."""
    return store.answer_assign(S.id_requests(spark, d), S.store_tickets(spark, d), S.agents(spark)).select("row_ord", "ticket_id", "status_code", "message", "agent_id")


@query
def tickets_after_assignment(spark, d):
    """All tickets with the agents that these requests leave."""
    tickets = S.store_tickets(spark, d)
    return store.reassigned(tickets, store.answer_assign(S.id_requests(spark, d), tickets, S.agents(spark))).select("ticket_id", "assigned_agent_id", "priority")


@query
def dashboard_bundle(spark, d):
    """Everything that the dashboard shows."""
    return store.dashboard_bundle(S.store_tickets(spark, d).drop("created_at"), S.agents(spark), S.feedback(spark, d), METRICS)


@query
def ticket_listing(spark, d):
    """Tickets as a page lists them."""
    return store.listing(S.store_tickets(spark, d), S.agents(spark))


@query
def known_confidence(spark, d):
    """The first confidence that each ticket has, as text."""
    return S.store_tickets(spark, d).select("ticket_id", X.first_known(F.col("category_confidence"), F.col("confidence")).alias("shown"))


@query
def usable_feedback(spark, d):
    """Validated feedback whose ticket has a text, as training rows."""
    rows = store.feedback_with_ticket(S.feedback(spark, d), S.raw_tickets(spark, d).drop("status"))
    return rows.where((F.col("validated") == 1) & (F.coalesce(F.length("ticket_text"), F.lit(0)) > 0)).select("feedback_id", "ticket_text", F.col("corrected_priority").alias("priority"))


@query
def value_subsets(spark, d):
    """Whether the values of each domain column are listed ones."""
    rows = S.raw_tickets(spark, d)
    out = evaluate.subset(rows, "category", fixed.CATEGORIES)
    return out.unionByName(evaluate.subset(rows, "priority", fixed.PRIORITIES)).unionByName(evaluate.subset(rows, "source", fixed.SOURCES))


@query
def surplus_rows(spark, d):
    """Rows beyond the first, whole and by column."""
    return profile.surplus(S.incoming(spark, d).select("ticket_id", "ticket_text", "category"), ("ticket_id", "ticket_text", "category"))


@query
def keyword_values(spark, d):
    return profile.keyword_values(S.tickets(spark, d), "ticket_text")


@query
def source_overlap(spark, d):
    """Texts that tickets of two sources share, raw, normalised and by pattern."""
    rows = S.tickets(spark, d).withColumns({"split": F.col("source"), "pattern": X.signature(F.col("ticket_text"))})
    return prepare.split_overlap(rows, "manual", "external")


@query
def reference_numbers(spark, d):
    """Ticket and feedback numbers that a key fixes."""
    return S.raw_tickets(spark, d).select("row_ord", X.reference_number("TICK-", F.col("row_ord")).alias("ticket"), X.reference_number("FB-", F.col("row_ord")).alias("feedback"))


#: Tickets of one category among 24 neighbours: the same matter, told in up to three languages.
MATTER, NEIGHBOURS = ("block", "category"), 24
#: What :func:`..functions.text.language_by_parts` tells apart.
LANGUAGES = ("english", "gujarati", "hinglish")


def _matters(spark, d):
    # Neighbours are dealt together, so that a task that aggregates matters has few rows left to shuffle.
    rows = S.tickets(spark, d, by=F.floor(F.col("o_orderkey") / NEIGHBOURS)).withColumns({"block": F.floor(F.col("row_ord") / NEIGHBOURS), "lang": X.language_by_parts(F.col("ticket_text"))})
    return rows.select("row_ord", "ticket_id", "ticket_text", "priority", "lang", *MATTER)


@query
def language_pairs(spark, d):
    """The same matter in English and in romanised Hindi: rule labels, signals' maxima, and whether the labels agree."""
    pairs = evaluate.language_pairs(_matters(spark, d), MATTER, "row_ord", "ticket_text", "english", "hinglish")
    told = lambda c: (X.rule_priority(F.col(c), F.lit("Medium"), F.lit("")), F.greatest(*[X.signal(F.col(c), s) for s in fixed.SIGNALS]))
    (en, en_top), (hi, hi_top) = told("one_text"), told("other_text")
    out = pairs.select(*MATTER, en.alias("en_label"), en_top.alias("en_top"), hi.alias("hi_label"), hi_top.alias("hi_top"))
    return out.withColumn("agree", F.col("en_label") == F.col("hi_label"))


@query
def language_consistency(spark, d):
    """Whether the predictor gives a matter told in several languages one category, and the right one."""
    rows = _matters(spark, d).select("row_ord", "ticket_text", "lang", *MATTER)
    return evaluate.by_language(_predicted(rows), MATTER, "prediction", "category", LANGUAGES, fixed.CATEGORIES)


@query
def language_consistency_score(spark, d):
    """The percentage of matters that get the right category in every language."""
    return evaluate.consistency_score(language_consistency(spark, d))


@query
def scenario_accuracy(spark, d):
    """How many scenarios, one a template, two rules get right: the labels' triggers, and the highest signal."""
    rows = evaluate.scenarios(S.tickets(spark, d), X.audit_signature(F.col("ticket_text")), "ticket_text", "priority", "row_ord")
    top = F.greatest(*[X.signal(F.col("text"), s) for s in fixed.SIGNALS])
    by_signal = F.when(top >= 0.95, "Critical").when(top >= 0.8, "High").when(top >= 0.4, "Medium").otherwise("Low")
    rows = rows.withColumns({"triggers": X.rule_priority(F.col("text"), F.lit("Medium"), F.lit("")), "signals": by_signal})
    return evaluate.scenario_accuracy(rows, "expected", ("triggers", "signals"))


@query
def diversity_report(spark, d):
    """Lengths, vocabulary, languages and keywords of all tickets."""
    return reports.diversity(S.tickets(spark, d))


@query
def validation_report(spark, d):
    """How many incoming tickets pass, and how many miss each rule."""
    return reports.validation(ingest.validate(S.incoming(spark, d)))


@query
def version_report(spark, d):
    """Sizes, distributions and splits of the dataset."""
    dense = _dense(spark, d)
    return reports.version(S.raw_tickets(spark, d), dense, prepare.with_split(dense))


@query
def comparison_report(spark, d):
    """Measures of two rules for priority, and the better one."""
    rows = _judged(spark, d).withColumn("always", F.lit("Medium"))
    found = None
    for i, model in enumerate(("predicted", "always")):
        told = evaluate.averages(rows, "priority", model)
        flat = told.select(F.lit("priority").alias("target"), F.lit(model).alias("model"), F.lit(i).alias("ord"), *[c for c in told.columns])
        found = flat if found is None else found.unionByName(flat)
    best = evaluate.best(found, "target", "weighted_f1", "ord").select("target", "model")
    return reports.models(found, best)


@query
def csv_round_trip(spark, d):
    """All raw tickets, written as CSV and read again."""
    path = files.scratch(spark, "csv")
    files.write_csv(S.require(S.raw_tickets(spark, d)), path)
    return S.read_csv(spark, path)


@query
def optional_sources(spark, d):
    """Tickets of the files that there are, of three that may be, each with its source filled in."""
    path, rows = files.scratch(spark, "sources"), S.raw_tickets(spark, d)
    for source in ("manual", "external"):
        given = rows.where(F.col("source") == source)
        files.write_csv(S.keep_known(given, ("ticket_id", "ticket_text", "category", "priority", "absent")), f"{path}/{source}")
    schema = "ticket_id string, ticket_text string, category string, priority string"
    return S.read_available(spark, {f"{path}/{s}": s for s in ("synthetic", "manual", "external")}, schema)


@query
def routed_ingest(spark, d):
    """Rows and distinct texts at each place that incoming tickets are routed to, and in the dataset that the accepted ones are added to."""
    path, old = files.scratch(spark, "routed"), S.raw_tickets(spark, d).where("status = 'F'").where("ticket_text is not null")
    decided = files.written(ingest.accept(S.incoming(spark, d).where("status <> 'F'"), S.raw_tickets(spark, d).where("status = 'F'")), "decided")
    ingest.write_routed(decided, path)
    ingest.append_first(old.select("ticket_text", "row_ord"), decided.where("validation_status = 'approved'").select("ticket_text", "row_ord"), f"{path}/dataset")
    count = lambda place: spark.read.parquet(f"{path}/{place}").agg(F.lit(place).alias("place"), F.count("*").alias("n"), F.countDistinct("ticket_text").alias("texts"))
    return reports.together(*map(count, (*ingest.PLACES, "dataset")))


@query
def bootstrap_tickets(spark, d):
    """What an empty store starts with: the records of the first 25 tickets, labelled by rule."""
    sure = F.lit(90.0)
    predict = lambda rows: rows.withColumns({"priority": X.rule_priority(F.col("ticket_text"), F.lit("Medium"), F.lit("")), "confidence": sure, "category_confidence": F.when(F.col("row_ord") % 2 == 0, sure), "priority_confidence": F.lit(None).cast("double")})
    rows = S.tickets(spark, d)
    return store.bootstrap(rows, S.store_tickets(spark, d).limit(0), predict, "row_ord")


@query
def json_metrics(spark, d):
    """Counts by category and priority, kept in one JSON document key by key and read again."""
    path, rows = f"{files.scratch(spark, 'json')}/metrics.json", S.tickets(spark, d, dealt=False)
    for column in ("category", "priority"):
        files.merge_json(spark, path, column, {r[column]: r.n for r in rows.groupBy(column).agg(F.count("*").alias("n")).collect()})  # a few values
    kept = files.read_json(spark, path)
    return spark.createDataFrame([(k, name, n) for k, counts in kept.items() for name, n in counts.items()], "field string, name string, n long")


@query
def store_replay(spark, d):
    """Tickets that a store holds after events before and after a compaction: put, closed, deleted, put again."""
    path, key = files.scratch(spark, "store"), F.col("id")
    # Each event takes some of the same rows, so they are made once, by all cores.
    rows = files.written(S.store_tickets(spark, d, dealt=True).withColumns({"created_at": F.col("created_at").cast("timestamp_ntz"), "status": F.lit("Open")}), "tickets")
    store.create(spark, path)
    turns = (("put", F.lit(True), "Open", 0), ("put", key % 5 == 0, "Closed", 1), ("delete", key % 7 == 0, "Open", 2), ("put", key % 21 == 0, "Reopened", 3), ("delete", key % 11 == 0, "Open", 4))
    for kind, which, status, turn in turns:
        store.append(rows.where(which).withColumns({"seq": key * 10 + turn + 10**12 * turn, "status": F.lit(status)}), path, "tickets", kind)
        if turn == 2:
            store.compact(spark, path, "tickets")
    return store.state(spark, path, "tickets", "ticket_id").select("id", "ticket_id", "category", "status", "assigned_agent_id")


@query
def generated_rules(spark, d):
    """As many generated tickets as there are orders: by category their number, different ids, and whether all are as they should be."""
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    rows = S.generate(spark, n)
    text = F.col("ticket_text")
    sound = F.col("ticket_id").rlike("^TICK-[0-9]{5,}$") & ~text.contains("{") & ~text.contains("}") & (F.length(text) > 10) & F.col("priority").isin(*fixed.PRIORITIES) & (F.col("department") == X.department(F.col("category"))) & (F.col("source") == "synthetic")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("ticket_id").alias("ids"), F.bool_and(sound).alias("sound"))


@query
def landing_stream(spark, d):
    """What the landing stream decides of all incoming tickets, which come in two runs: even orders, then odd ones."""
    path = files.scratch(spark, "stream")
    rows = S.incoming(spark, d).withColumn("created_at", F.lit(None).cast("string"))
    # A file with line ends in fields is one task's, so there are as many as the rows need.
    parts = max(4, -(-rows.count() // files.DEALT))
    for turn in (0, 1):
        # The names of the parts are in the order of the rows.
        given = rows.where(F.col("row_ord") % 2 == turn).repartitionByRange(parts, "row_ord").sortWithinPartitions("row_ord").select(*S.INCOMING.names)
        files.write_csv(given, f"{path}/in", "append")
        ingest_stream(spark, f"{path}/in", f"{path}/out", f"{path}/state").awaitTermination()
    there = [p for p in ingest.PLACES if files.exists(spark, f"{path}/out/{p}")]
    told = [spark.read.parquet(f"{path}/out/{p}").select("ticket_id", "ticket_text", F.lit("").alias("rejection_reason") if p != "rejected" else F.col("rejection_reason"), "batch") for p in there]
    return reports.together(*told).groupBy("batch", "rejection_reason").agg(F.count("*").alias("n"), F.countDistinct("ticket_text").alias("texts"))
