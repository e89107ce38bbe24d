"""The serving store as append-only events and views: joins, latest state, requests with their answers, dashboard.

A request is a row; answering a batch of them is one plan over the current state, which gives every request its status
and message, and the events to append. Nothing is updated in place: the view takes each key's last event.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X
from ..sources import files
from . import snapshots

# The store's relations.
SCHEMAS = {
    "agents": "id long, name string, department string, is_active int",
    "tickets": "id long, ticket_id string, ticket_text string, category string, priority string, department string, confidence double, category_confidence double, priority_confidence double, status string, created_at timestamp_ntz, assigned_agent_id long",
    "priority_feedback": "id long, feedback_id string, ticket_id string, ticket_text string, original_priority string, corrected_priority string, original_priority_confidence double, reason string, reviewer string, validated int, created_at timestamp_ntz",
}
KEYS = {"agents": "id", "tickets": "ticket_id", "priority_feedback": "feedback_id"}


def create(spark: SparkSession, path: str) -> None:
    """An empty event table per relation, where there is none yet: rows with a sequence number and a kind."""
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], f"seq long, kind string, {schema}").write.mode("ignore").parquet(f"{path}/{name}")


class Conflict(RuntimeError):
    """Another writer has taken the sequence number that this one counted on."""


def claim(spark: SparkSession, path: str, name: str, seq: int) -> None:
    """Take a sequence number of a relation for one writer; raises :class:`Conflict` if events, or another's claim, have reached it.

    A marker file is created where there must be none yet, which the file system does for one writer alone. A claim is not given back: a
    writer that fails after it takes the next number.
    """
    if next_seq(spark, path, name) > seq or not files.create_new(spark, f"{path}/claims/{name}/{seq}"):
        raise Conflict(f"{name}: number {seq} is taken; read the state again")


def append(rows: DataFrame, path: str, name: str, kind: str = "put", expect: int | None = None) -> None:
    """Add events; columns that are missing are null, as an additive migration leaves them, and unknown ones stay out.

    ``expect``: the number from :func:`next_seq` that the rows were made after; if another writer has been faster,
    :class:`Conflict` is raised and nothing is written.
    """
    spark = rows.sparkSession
    if expect is not None:
        claim(spark, path, name, expect)
    empty = spark.createDataFrame([], f"seq long, kind string, {SCHEMAS[name]}")
    empty.unionByName(rows.withColumn("kind", F.lit(kind)), allowMissingColumns=True).select(*empty.columns).write.mode("append").parquet(f"{path}/{name}")


def _events(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).schema(f"seq long, kind string, {SCHEMAS[name]}").parquet(f"{path}/{name}")


def state(spark: SparkSession, path: str, name: str, key: str) -> DataFrame:
    """The rows that a relation's snapshot, if it has one, and its events leave; columns that older files lack are null."""
    events = _events(spark, path, name)
    found = snapshots.state(spark, path, name, key, events)
    return latest(events, key) if found is None else found


def compact(spark: SparkSession, path: str, name: str, bucket_rows: int = snapshots.BUCKET_ROWS) -> int:
    """Make the state of now a relation's snapshot and delete the event files it holds; returns how many."""
    key, through = KEYS[name], next_seq(spark, path, name) - 1
    # The rows of a first snapshot are counted by what settles whether a key is there, not by making them.
    keys = latest(_events(spark, path, name).select(key, "seq", "kind"), key)
    snapshots.compact(spark, path, name, key, state(spark, path, name, key), through, bucket_rows, keys)
    return snapshots.trim(spark, path, name)


def next_seq(spark: SparkSession, path: str, name: str) -> int:
    """A sequence number after all events of a relation."""
    events = spark.read.schema("seq long").parquet(f"{path}/{name}")
    return max(events.agg(F.max("seq")).first()[0] or 0, snapshots.pointer(spark, path, name).get("through", 0)) + 1


def latest(events: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Each key's last event by ``seq``, equal keys combined before they are shuffled; keys last deleted are absent.

    Events of one key and ``seq`` are ordered by their other columns, so the row that stays is one that was there.
    """
    rest = [c for c in events.columns if c != key]
    order = F.struct(seq, *[c for c in rest if c != seq])
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(*events.columns)
    return last.where("kind <> 'delete'").drop("kind") if "kind" in events.columns else last


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """``old`` and of each new key the first row of ``new`` by ``order``."""
    rest = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_row")).select(*key, "_row.*").select(*new.columns)
    return old.unionByName(first.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def with_agent(tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """Tickets with their agent's name, Unassigned where there is none. The agents are a dimension of people."""
    names = agents.select(F.col("id").alias("assigned_agent_id"), F.col("name").alias("agent"))
    return tickets.join(names, "assigned_agent_id", "left").withColumn("agent", F.coalesce("agent", F.lit("Unassigned")))


def recent(tickets: DataFrame, agents: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` newest tickets with their agents: cut first, joined after."""
    return with_agent(tickets.orderBy(F.desc("created_at"), F.desc("id")).limit(k), agents)


def feedback_with_ticket(feedback: DataFrame, tickets: DataFrame) -> DataFrame:
    """Feedback beside the text, priority and confidence that its ticket has."""
    confidence = F.coalesce("priority_confidence", "confidence") if "confidence" in tickets.columns else F.lit(None).cast("double")
    known = tickets.select("ticket_id", "ticket_text", F.col("priority").alias("original_priority"), confidence.alias("original_priority_confidence"))
    return feedback.join(known, "ticket_id")


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """All, validated and pending feedback."""
    out = feedback.agg(F.count("*").alias("total"), F.count_if(F.col("validated") == 1).alias("validated"))
    return out.withColumn("pending", F.col("total") - F.col("validated"))


def _pick(tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """``tickets`` with the department's team and the agent picked from it, by a hash of both ids; its own agent is no choice."""
    team = agents.where("is_active = 1").groupBy("department").agg(F.array_sort(F.collect_list(F.struct("id", "name"))).alias("team"))  # a department's few agents
    rows = tickets.join(team, "department", "left")
    others = F.filter("team", lambda a: F.coalesce(a["id"] != F.col("assigned_agent_id"), F.lit(True)))
    hashed = F.transform(others, lambda a: F.struct(F.md5(F.concat(F.col("ticket_id"), F.lit("|"), a["id"].cast("string"))).alias("h"), a["id"].alias("id"), a["name"].alias("name")))
    return rows.withColumn("_picked", F.array_min(hashed))


def assign(tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """Each ticket's new agent: an active one of its department other than its own.

    status 200; 409 where the department has no active agent, or only the one that the ticket has.
    """
    rows = _pick(tickets, agents)
    reason = F.when(F.col("team").isNull(), "no active agent").when(F.col("_picked").isNull(), "already with the only active agent")
    return rows.select("ticket_id", "department", F.col("_picked.id").alias("agent_id"), F.when(reason.isNull(), 200).otherwise(409).alias("status"), reason.alias("message"))


def told(message: str, **values: Column) -> Column:
    """A fixed message with its braces filled; nulls count as empty."""
    parts = re.split(r"\{(\w+)\}", fixed.MESSAGES[message])
    return joined(*[values[p] if i % 2 else p for i, p in enumerate(parts)])


def joined(*parts: str | Column) -> Column:
    """Texts and columns one after another; never null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def answer_assign(requests: DataFrame, tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """``requests`` (ticket_id, ...) with status_code, message, agent_id: 404 without such a ticket, 409 without another agent."""
    ids = requests.select("ticket_id").distinct()
    known = _pick(tickets.join(ids, "ticket_id", "left_semi").select("ticket_id", "department", "assigned_agent_id"), agents)
    known = known.select("ticket_id", "department", F.col("team").isNotNull().alias("_staffed"), "_picked", F.lit(True).alias("_known"))
    ticket, picked = F.col("ticket_id"), F.col("_picked")
    code = F.when(F.col("_known").isNull(), 404).when(picked.isNull(), 409).otherwise(200)
    message = (
        F.when(F.col("_known").isNull(), told("not_found", id=ticket))
        .when(~F.col("_staffed"), told("no_agents", department=F.col("department")))
        .when(picked.isNull(), told("only_agent", id=ticket, department=F.col("department")))
        .otherwise(told("assigned", id=ticket, name=picked["name"]))
    )
    return requests.join(known, "ticket_id", "left").select(*requests.columns, code.alias("status_code"), message.alias("message"), picked["id"].alias("agent_id"))


def answer_delete(requests: DataFrame, tickets: DataFrame, order: str) -> DataFrame:
    """``requests`` (ticket_id, ``order``) with status_code and message: 400 for a blank id, 404 for an unknown one.

    Of several requests for one ticket the first by ``order`` finds it, the others come too late.
    """
    ticket = F.col("ticket_id")
    first = requests.groupBy("ticket_id").agg(F.min(order).alias("_first"))
    known = tickets.select("ticket_id").distinct().withColumn("_known", F.lit(True))
    rows = requests.join(first, "ticket_id", "left").join(known, "ticket_id", "left")
    blank = F.coalesce(X.strip(ticket) == "", F.lit(True))
    found = F.col("_known").isNotNull() & (F.col(order) == F.col("_first"))
    code = F.when(blank, 400).when(found, 200).otherwise(404)
    message = F.when(blank, told("delete_no_id")).when(found, told("deleted", id=ticket)).otherwise(told("not_found", id=ticket))
    return rows.select(*requests.columns, code.alias("status_code"), message.alias("message"))


def without(tickets: DataFrame, answers: DataFrame) -> DataFrame:
    """Tickets that no answered delete request has taken; feedback about them stays where it is."""
    return tickets.join(answers.where("status_code = 200").select("ticket_id"), "ticket_id", "left_anti")


def text_field(body: Column, name: str, default: str = "") -> Column:
    """A text field of a JSON object, trimmed; ``default`` where it is missing, no text, or the body no object."""
    return F.coalesce(X.strip(json_text(body, name)), F.lit(default))


def json_text(body: Column, name: str) -> Column:
    """A text field of a JSON object as it is; null where it is missing, no text, or the body no object."""
    value = F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant")
    return X.bound(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def truth_field(body: Column, name: str, default: bool = False) -> Column:
    """1 for the JSON values 1, 1.0, true, "1" and "true", else 0; ``default`` where the field is missing."""
    return X.bound(F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant"), lambda value: _truth(value, default))


def _truth(value: Column, default: bool) -> Column:
    kind = F.schema_of_variant(value)
    yes = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", F.try_variant_get(value, "$", "string").isin("1", "true"))
    yes = yes.when(kind == "VOID", False).otherwise(F.try_variant_get(value, "$", "double") == 1.0)
    return F.when(value.isNull(), F.lit(int(default))).otherwise(F.coalesce(yes, F.lit(False)).cast("int"))


def ticket_texts(requests: DataFrame) -> DataFrame:
    """``requests`` (body, ...) with the gated ticket_text, or the message and status_code that turn it away."""
    return requests.withColumn("_gate", X.gate(json_text(F.col("body"), "ticket_text"))).select(*requests.columns, "_gate.*")


def answer_feedback(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """``requests`` (body, ...) with status_code, message and the feedback that a good one makes.

    400 without a ticket id or with an unlisted priority, 404 for an unknown ticket, else 201; reviewer and flag have
    defaults, the ticket's priority, confidence and text are copied.
    """
    body = F.col("body")
    fields = {"ticket_id": text_field(body, "ticket_id"), "corrected_priority": text_field(body, "corrected_priority"), "reason": text_field(body, "reason")}
    reviewer = text_field(body, "reviewer", "agent")
    rows = requests.withColumns(fields | {"reviewer": F.when(reviewer == "", "agent").otherwise(reviewer), "validated": truth_field(body, "validated")})
    confidence = F.coalesce("priority_confidence", "confidence")
    known = tickets.select("ticket_id", "ticket_text", F.col("priority").alias("original_priority"), confidence.alias("original_priority_confidence"), F.lit(True).alias("_known"))
    rows = rows.join(known, "ticket_id", "left")
    listed = F.lit(str(list(fixed.PRIORITIES)))
    code = F.when(F.col("ticket_id") == "", 400).when(~F.col("corrected_priority").isin(*fixed.PRIORITIES), 400).when(F.col("_known").isNull(), 404).otherwise(201)
    message = (
        F.when(F.col("ticket_id") == "", told("feedback_no_id"))
        .when(code == 400, told("feedback_priority", listed=listed))
        .when(code == 404, told("feedback_unknown", id=F.col("ticket_id")))
        .otherwise(told("feedback_taken"))
    )
    return rows.withColumns({"status_code": code, "message": message}).drop("_known", "body")


def answer_validation(requests: DataFrame, feedback: DataFrame) -> DataFrame:
    """``requests`` (body, ...) with feedback_id, validated (true by default), status_code and message: 400 without an id, 404 for an unknown one."""
    body = F.col("body")
    rows = requests.withColumns({"feedback_id": text_field(body, "feedback_id"), "validated": truth_field(body, "validated", True)})
    rows = rows.join(feedback.select("feedback_id").distinct().withColumn("_known", F.lit(True)), "feedback_id", "left")
    code = F.when(F.col("feedback_id") == "", 400).when(F.col("_known").isNull(), 404).otherwise(200)
    message = (
        F.when(code == 400, told("flag_no_id"))
        .when(code == 404, told("flag_unknown", id=F.col("feedback_id")))
        .otherwise(told("flag_set", id=F.col("feedback_id"), flag=F.col("validated")))
    )
    return rows.withColumns({"status_code": code, "message": message}).drop("_known", "body")


def flagged(feedback: DataFrame, answers: DataFrame, order: str) -> DataFrame:
    """Feedback with the flag that the last good request by ``order`` sets; all other fields stay."""
    last = answers.where("status_code = 200").groupBy("feedback_id").agg(F.max_by("validated", F.struct(order, "validated")).alias("_flag"))
    return feedback.join(last, "feedback_id", "left").withColumn("validated", F.coalesce("_flag", "validated")).drop("_flag").select(*feedback.columns)


def reassigned(tickets: DataFrame, answers: DataFrame) -> DataFrame:
    """Tickets with the agents that good assignment requests give them; all other fields stay."""
    given = answers.where("status_code = 200").groupBy("ticket_id").agg(F.max("agent_id").alias("_agent"))  # equal requests pick the same agent
    return tickets.join(given, "ticket_id", "left").withColumn("assigned_agent_id", F.coalesce("_agent", "assigned_agent_id")).drop("_agent").select(*tickets.columns)


def bootstrap(rows: DataFrame, tickets: DataFrame, predict, order: str, k: int = 25) -> DataFrame:  # noqa: ANN001
    """What a store starts with: the prediction records of the first ``k`` rows as open tickets, none if there are tickets already."""
    if not tickets.isEmpty():
        return tickets.limit(0)
    found = predict(rows.orderBy(order).limit(k))
    return found.select(
        F.col(order).cast("long").alias("id"), "ticket_id", "ticket_text", "category", "priority", "department", "confidence",
        F.coalesce("category_confidence", F.lit(95.0)).alias("category_confidence"), F.coalesce("priority_confidence", F.lit(80.0)).alias("priority_confidence"), F.lit("Open").alias("status"),
    )


def dashboard(tickets: DataFrame, feedback: DataFrame) -> DataFrame:
    """(metric, key, n): the totals and distributions of the dashboard."""
    columns = ("category", "priority", "department")
    which = F.when(F.grouping("category") == 0, "category").when(F.grouping("priority") == 0, "priority").when(F.grouping("department") == 0, "department").otherwise("total")
    key = F.when(F.grouping_id() == 7, F.lit("tickets")).otherwise(F.coalesce(*columns))  # of one set all but one are null
    # One scan: the total and the three distributions are grouping sets, added up before they are shuffled.
    counts = tickets.groupingSets([[c] for c in columns] + [[]], *columns).agg(which.alias("metric"), key.alias("key"), F.count("*").alias("n")).select("metric", "key", "n")
    marks = feedback.select(F.when(F.col("validated") == 1, "validated").otherwise("pending").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    empty = tickets.sparkSession.createDataFrame([("total", "tickets", 0)], counts.schema)  # an empty table has a total as well
    counts = counts.unionByName(empty).groupBy("metric", "key").agg(F.sum("n").alias("n"))
    return counts.unionByName(marks.select(F.lit("feedback").alias("metric"), "key", "n"))


def newest(rows: DataFrame, by: str = "id", k: int = 10) -> DataFrame:
    """The ``k`` rows with the largest ``by``, numbered from 1; ties by the other columns."""
    rest = [F.col(c) for c in rows.columns if c != by]
    cut = rows.orderBy(F.desc(by), *rest).limit(k)
    return cut.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), *rest)))  # k rows


def dashboard_bundle(tickets: DataFrame, agents: DataFrame, feedback: DataFrame, metrics: dict) -> DataFrame:
    """(section, key, value): everything that the dashboard shows, recent tickets and feedback and the saved model metrics included."""
    spark = tickets.sparkSession
    counts = dashboard(tickets, feedback).select(F.col("metric").alias("section"), "key", F.col("n").cast("string").alias("value"))
    lately = with_agent(newest(tickets), agents).select(F.lit("recent_ticket").alias("section"), F.col("place").cast("string").alias("key"), joined(F.col("ticket_id"), " | ", F.col("priority"), " | ", F.col("agent")).alias("value"))
    lately_told = newest(feedback).select(F.lit("recent_feedback").alias("section"), F.col("place").cast("string").alias("key"), joined(F.col("feedback_id"), " | ", F.col("corrected_priority")).alias("value"))
    saved = [("saved_accuracy", target, saved_accuracy(metrics.get(f"{target}_metrics"), metrics.get(f"best_{target}_model"))) for target in ("category", "priority")]
    return counts.unionByName(lately).unionByName(lately_told).unionByName(spark.createDataFrame(saved, "section string, key string, value string"))


def saved_accuracy(by_model: dict | None, best: str | None) -> str:
    """The best model's saved accuracy in percent; a dash where it is missing, no number, or not between 0 and 1."""
    found = (by_model or {}).get(best) if isinstance(by_model, dict) else None
    value = found.get("accuracy") if isinstance(found, dict) else None
    sound = isinstance(value, (int, float)) and not isinstance(value, bool) and 0 <= value <= 1
    return f"{value * 100:.2f}%" if sound else "—"


def listing(tickets: DataFrame, agents: DataFrame) -> DataFrame:
    """Tickets as a page lists them: the confidence that there is as a percentage, and what its button offers."""
    rows = with_agent(tickets, agents)
    sure = F.coalesce("category_confidence", "confidence")
    return rows.select(
        "ticket_id", "agent", F.coalesce(X.percent(sure), F.lit("--")).alias("confidence"),
        F.when(F.col("agent") != "Unassigned", "Reassign Agent").otherwise("Assign Agent").alias("action"),
    )
