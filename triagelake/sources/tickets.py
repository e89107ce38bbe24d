"""Ticket-shaped relations over the input tables, and files of tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import text as X
from . import files

RAW_COLUMNS = ("ticket_id", "ticket_text", "category", "priority", "source")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
INCOMING = T.StructType([*RAW.fields, T.StructField("created_at", T.StringType())])

#: (category, text) of the demonstration tickets; {id} is the ticket's number.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Billing", "I was charged twice for invoice {id}, please help immediately."),
    ("Billing", "The wrong amount of $45.50 is on my receipt #{id}"),
    ("Billing", "Mera card do baar charge ho gaya hai, jaldi help karo"),
    ("Technical Support", "The app keeps crashing with error code ERR_{id} since today"),
    ("Technical Support", "How to use dark mode on the page?"),
    ("Technical Support", "Production down: system outage for all users, server 10.0.0.1 fails. Urgent attention required."),
    ("Refund", "My refund has not arrived for order {id}. Thank you for your assistance."),
    ("Refund", "Refund chahiye, paise wapas karo"),
    ("Refund", "રિફંડ ક્યારે મળશે {id}"),
    ("Shipping", "My package {id} is delayed by 2 days"),
    ("Shipping", "Where is my parcel? Please advise as soon as possible."),
    ("Shipping", "Mera order kahan hai"),
    ("Account", "My account was hacked by unauthorized access at 192.168.1.20"),
    ("Account", "I am locked out and cannot login, otp issue"),
    ("Account", "કોઈ મારા ખાતામાં ઘૂસ્યું, હેક લાગે છે"),
    ("Complaint", "The product {id} came damaged and completely broken!"),
    ("Complaint", "Your agent was slow to answer; this is a complaint"),
    ("Complaint", "Status update nathi, order {id}"),
    ("Product Inquiry", "What is the pricing of the model PRO-{id}?"),
    ("Product Inquiry", "Is it compatible with macos? No rush."),
    ("Product Inquiry", "Can you help with the documentation for Q1 2024"),
    ("Cancellation", "Cancel subscription immediately, ticket {id}"),
    ("Cancellation", "Please stop the auto renewal. Thanks for your help!"),
    ("Cancellation", "I want to cancel whenever possible"),
)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def raw_tickets(spark: SparkSession, sf_dir: str, dealt: bool = True, by: str | Column = "o_orderkey") -> DataFrame:
    """Orders as raw tickets with blemishes: null and blank texts, unknown and oddly written domains.

    ``dealt``: over all cores, in parts of bounded size, ``by`` what is to stay together; worth its shuffle where a text kernel follows.
    """
    key = F.col("o_orderkey")
    which = key % len(TEMPLATES)
    text = X.fill(_pick(tuple(t for _, t in TEMPLATES), which), id=key.cast("string"))
    category = _pick(tuple(c for c, _ in TEMPLATES), which)
    level = F.substring("o_orderpriority", 1, 1)
    priority = F.when(level == "1", "Critical").when(level == "2", "High").when(level == "5", "Low").otherwise("Medium")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderstatus")
    return (files.dealt(orders, by) if dealt else orders).select(
        F.concat(F.lit("TICK-"), key.cast("string")).alias("ticket_id"),
        F.when(key % 97 == 0, F.lit(None)).when(key % 89 == 0, "   ").when(key % 11 == 0, F.concat(F.lit("  "), text)).otherwise(text).alias("ticket_text"),
        F.when(key % 83 == 0, "Unknown").when(F.col("o_custkey") % 5 == 0, F.upper(category)).otherwise(category).alias("category"),
        F.when(key % 79 == 0, F.lit(None)).otherwise(priority).alias("priority"),
        _pick(fixed.SOURCES, F.col("o_custkey") % 3).alias("source"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        key.alias("row_ord"),
    )


def tickets(spark: SparkSession, sf_dir: str, dealt: bool = True, by: str | Column = "o_orderkey") -> DataFrame:
    """The raw tickets that are sound, with domains written as they are listed."""
    rows = raw_tickets(spark, sf_dir, dealt, by)
    return (
        rows.withColumns({"ticket_text": F.trim("ticket_text"), "category": X.title(F.col("category"), fixed.CATEGORIES)})
        .where("ticket_text is not null and ticket_text <> '' and category is not null and priority is not null")
        .withColumn("department", X.department(F.col("category")))
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw tickets as a landing file would hold them, some with personal data, short texts or taken ids."""
    key = F.col("row_ord")
    return raw_tickets(spark, sf_dir).select(
        F.when(key % 7 == 0, "TICK-1").otherwise(F.col("ticket_id")).alias("ticket_id"),
        F.when(key % 13 == 0, "hi").when(key % 17 == 0, F.concat("ticket_text", F.lit(" mail me at a.b@c.org"))).when(key % 19 == 0, F.concat("ticket_text", F.lit(" call 555-123-4567"))).otherwise(F.col("ticket_text")).alias("ticket_text"),
        "category", "priority", F.when(key % 23 == 0, "fax").otherwise(F.col("source")).alias("source"), "status", "row_ord",
    )


def agents(spark: SparkSession) -> DataFrame:
    """The demo agents; every fifth is inactive."""
    rows = [(i, name, team, int(i % 5 != 0)) for i, (name, team) in enumerate(fixed.AGENTS, 1)]
    return spark.createDataFrame(rows, "id long, name string, department string, is_active int")


def store_tickets(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Tickets as the store keeps them, most with an agent; some have one confidence alone, some none. ``dealt``: as :func:`raw_tickets` has it."""
    key = F.col("row_ord")
    sure = (key * 37 % 10000) / F.lit(100.0)
    return tickets(spark, sf_dir, dealt).select(
        key.alias("id"), "ticket_id", "ticket_text", "category", "priority", "department", "created_at",
        F.when(key % 4 == 0, F.lit(None).cast("long")).otherwise(key % 20 + 1).alias("assigned_agent_id"),
        F.when(key % 9 != 0, sure).alias("confidence"), F.when(key % 3 != 0, sure).alias("category_confidence"), F.when(key % 5 != 0, sure / 2).alias("priority_confidence"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned order lines as priority feedback."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    return lines.select(
        F.concat(F.lit("FB-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("feedback_id"),
        F.concat(F.lit("TICK-"), F.col("l_orderkey").cast("string")).alias("ticket_id"),
        _pick(fixed.PRIORITIES, F.col("l_linenumber") % 4).alias("corrected_priority"),
        (F.col("l_linestatus") == "F").cast("int").alias("validated"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
    )


def ticket_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies that carry ticket texts: objects, and some that are lists, cut short, without the field, or with a number for it."""
    key, text = F.col("row_ord"), F.coalesce("ticket_text", F.lit(""))
    body = F.concat(F.lit('{"ticket_text": "'), text, F.lit('"}'))
    odd = F.when(key % 31 == 0, F.lit(None)).when(key % 29 == 0, F.concat(F.lit("["), body, F.lit("]"))).when(key % 23 == 0, F.lit('{"ticket_text": "cut'))
    return raw_tickets(spark, sf_dir).select("row_ord", odd.when(key % 19 == 0, F.lit('{"text": "x"}')).when(key % 17 == 0, F.lit('{"ticket_text": 17}')).otherwise(body).alias("body"))


def feedback_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies with corrected priorities: some without an id, for unknown tickets, with unlisted priorities, with flags of all kinds."""
    key = F.col("row_ord")
    ticket = F.when(key % 13 == 0, "  ").when(key % 11 == 0, F.concat(F.lit("NONE-"), key.cast("string"))).otherwise(F.concat(F.lit(" TICK-"), key.cast("string")))
    priority = F.when(key % 7 == 0, "Urgent").otherwise(_pick(fixed.PRIORITIES, key % 4))
    flag = _pick(("1", "true", '"1"', '"true"', "0", "false", '"yes"', "null", "1.0"), key % 9)
    head = F.concat(F.lit('{"ticket_id": "'), ticket, F.lit('", "corrected_priority": " '), priority, F.lit('"'))
    rest = F.when(key % 2 == 0, F.concat(F.lit(', "validated": '), flag)).otherwise("")
    reviewer = F.when(key % 3 == 0, ', "reviewer": "  "').when(key % 3 == 1, ', "reviewer": "lead "').otherwise("")
    return raw_tickets(spark, sf_dir).select("row_ord", F.when(key % 37 == 0, "not json").otherwise(F.concat(head, rest, reviewer, F.lit("}"))).alias("body"))


def validation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies that flag feedback; some without an id, for unknown feedback, or twice."""
    key = F.col("id")
    told = F.when(key % 7 == 0, "").when(key % 11 == 0, "FB-none").otherwise(F.col("feedback_id"))
    rest = F.when(key % 3 == 0, ', "validated": 0').when(key % 3 == 1, ', "validated": true').otherwise("")
    rows = feedback(spark, sf_dir).withColumn("place", F.explode(F.sequence(F.lit(0), F.when(key % 5 == 0, 1).otherwise(0))))
    return rows.select((key * 2 + F.col("place")).alias("row_ord"), F.concat(F.lit('{"feedback_id": "'), told, F.lit('"'), F.when(F.col("place") == 1, ', "validated": "true"').otherwise(rest), F.lit("}")).alias("body"))


def id_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name a ticket: blank and unknown ids among them, and some twice."""
    key = F.col("row_ord")
    rows = raw_tickets(spark, sf_dir).withColumn("place", F.explode(F.sequence(F.lit(0), F.when(key % 6 == 0, 1).otherwise(0))))
    told = F.when(key % 41 == 0, " ").when(key % 43 == 0, F.concat(F.lit("GONE-"), key.cast("string"))).otherwise(F.col("ticket_id"))
    return rows.select((key * 2 + F.col("place")).alias("row_ord"), told.alias("ticket_id"))


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType = RAW) -> DataFrame:
    """CSV files with a header; quoted fields may hold quotes and line ends, the usual marks of absence are null."""
    rows = spark.read.schema(schema).csv(paths, header=True, quote='"', escape='"', multiLine=True, enforceSchema=False)
    absent = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A")
    return rows.select(*[F.when(~F.col(c).isin(*absent), F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def read_available(spark: SparkSession, paths: dict[str, str], schema: T.StructType = RAW) -> DataFrame:
    """The union of those files that exist, source filled in by file; raises FileNotFoundError if none does."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path, source in paths.items():
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            rows = read_csv(spark, path, schema)
            found.append(rows.withColumn("source", F.coalesce("source", F.lit(source))) if "source" in rows.columns else rows.withColumn("source", F.lit(source)))
    if not found:
        raise FileNotFoundError("none of the ticket files exists")
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def is_landed(name: Column) -> Column:
    """Whether a landing file is neither a processed nor a rejected one."""
    return ~name.startswith("processed_") & ~name.startswith("rejected_")


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """All CSV files of a landing folder that are neither processed nor rejected ones."""
    rows = spark.read.schema(INCOMING).csv(folder, header=True, quote='"', escape='"', multiLine=True, pathGlobFilter="*.csv")
    return rows.where(is_landed(F.col("_metadata.file_name")))


def keep_known(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Those of ``columns`` that ``rows`` has, in order."""
    return rows.select(*[c for c in columns if c in rows.columns])


def require(rows: DataFrame, columns: tuple[str, ...] = RAW_COLUMNS) -> DataFrame:
    """Exactly ``columns``, in order; raises KeyError where one is missing."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise KeyError(f"required columns are missing: {', '.join(missing)}")
    return rows.select(*columns)


# What fills the generator's placeholders, and what stands before and behind its texts.
AMOUNTS, PLAN_AMOUNTS = ("19.99", "49.0", "99.99", "149.0", "249.5", "499.0"), ("9.99", "29.99", "79.99")
PERIODS, ERROR_CODES = ("Jan 2026", "Feb 2026", "Q1 2026"), ("ERR_502", "NULL_POINTER_EXC", "SOCKET_TIMEOUT", "AUTH_DENIED")
PREFIXES = ("Hi support team, ", "Hello, ", "Hey there, ", "Dear customer service, ", "Urgent: ", "Quick question - ", "FYI, ", "Plz help - ", "")
SUFFIXES = (
    " Please advise as soon as possible.", " Thanks for your help!", " Urgent attention required.", " Contact me via email or phone.", " Appreciate a quick update on this.",
    " Kindly look into this matter promptly.", " Looking forward to hearing back.", " Plz respond asap.", "",
)
#: By category: what a text is about, and what is said of it with the priority that this has.
MATTERS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...]]] = {
    "Billing": (("my {period} statement", "invoice {id}", "the ${plan_amount} charge", "the tax on invoice {id}", "the receipt for ${amount}"), (("There is a mistake in {}.", "Medium"), ("Could you send me {} once more?", "Low"), ("I do not recognise {} and want it looked into.", "High"), ("{} was taken from my card two times", "Critical"))),
    "Technical Support": (("the {model} client", "the export page", "the server at {ip}", "my login screen", "the mobile app"), (("{} stops with {err_code}.", "High"), ("Since the update {} is slow.", "Medium"), ("How do I set up {}?", "Low"), ("Nobody in our office can use {}, everything is down!", "Critical"))),
    "Refund": (("order {id}", "the ${amount} I paid", "my cancelled {model}", "the unused ${plan_amount} plan", "the deposit from {period}"), (("I am still waiting for the money back for {}.", "Medium"), ("What are the terms for getting {} refunded?", "Low"), ("You promised a refund of {} weeks ago and nothing came.", "High"), ("The refund for {} went to a stranger's account", "Critical"))),
    "Shipping": (("parcel {id}", "my {model}", "the replacement for order {id}", "the express delivery", "the second half of order {id}"), (("When will {} arrive?", "Low"), ("The tracking of {} has not moved for days.", "Medium"), ("{} was left at a wrong address!", "High"), ("{} holds medicine and is lost", "Critical"))),
    "Account": (("my account", "the profile of user {id}", "my sign-in", "the team account", "my recovery address"), (("Please help me to change {}.", "Low"), ("I cannot get into {} since this morning.", "High"), ("Some settings of {} are gone.", "Medium"), ("Someone at {ip} has broken into {}", "Critical"))),
    "Complaint": (("the {model}", "your hotline", "the answer to ticket {id}", "the technician", "the packaging of order {id}"), (("I am not happy with {}.", "Medium"), ("A small remark about {}: it could be friendlier.", "Low"), ("{} was a disaster, I want a manager to call me.", "High"), ("{} has hurt a customer of ours", "Critical"))),
    "Product Inquiry": (("the {model}", "the ${plan_amount} plan", "the family offer", "the interface for developers", "the offer of {period}"), (("Does {} work with older devices?", "Low"), ("What does {} cost for a team of ten?", "Low"), ("I have to decide on {} by tomorrow, please call.", "High"), ("The page on {} contradicts the manual.", "Medium"))),
    "Cancellation": (("my ${plan_amount} plan", "order {id}", "the automatic renewal", "the trial of {model}", "our contract from {period}"), (("Please cancel {}.", "Medium"), ("How do I cancel {} without a fee?", "Low"), ("I cancelled {} long ago and am still charged!", "High"), ("Stop {} at once, it was signed with forged papers", "Critical"))),
}


def composed(matters: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str], ...]]] = MATTERS) -> tuple[tuple[str, str, str, str], ...]:
    """English templates: everything said of every matter, the first letter in upper case."""
    fill = lambda said, about: said.replace("{}", about)
    upper = lambda t: t if t.startswith("{") else t[0].upper() + t[1:]
    return tuple((category, upper(fill(said, about)), base, "en") for category, (about_, said_) in matters.items() for about in about_ for said, base in said_)


#: (category, text, base priority, language) of the generator's own templates.
GENERATED: tuple[tuple[str, str, str, str], ...] = (
    *((c, t, ("Low", "Medium", "High", "Critical")[i % 4], "gujarati" if any("\u0a80" <= x <= "\u0aff" for x in t) else "hinglish" if any(w in t.split() for w in ("Mera", "chahiye,", "nathi,")) else "en") for i, (c, t) in enumerate(TEMPLATES)),
    ("Billing", "Invoice {id} lists ${amount} although my plan costs ${plan_amount} a month.", "Medium", "en"),
    ("Billing", "The statement for {period} is missing.", "Low", "en"),
    ("Technical Support", "Error {err_code} appears whenever the server {ip} restarts.", "High", "en"),
    ("Technical Support", "Model {model} stops with {err_code}", "Medium", "en"),
    ("Refund", "Please return the ${amount} that I paid in {period}.", "Medium", "en"),
    ("Shipping", "Order {id} with a {model} never left the depot.", "High", "en"),
    ("Account", "Someone from {ip} signed in to my account", "Critical", "en"),
    ("Complaint", "The {model} for ${amount} broke within a day!", "High", "en"),
    ("Product Inquiry", "Does {model} come with the ${plan_amount} plan?", "Low", "en"),
    ("Cancellation", "Stop my ${plan_amount} plan at the end of {period}", "Low", "en"),
    *composed(),
)


def generate(spark: SparkSession, n: int, seed: int = 42, templates: tuple[tuple[str, str, str, str], ...] = GENERATED) -> DataFrame:
    """``n`` synthetic tickets, the categories in equal parts, labelled by rule and in shuffled order; the same for the same seed on any cluster.

    ``templates``: (category, text with placeholders, base priority, language); English texts may get a greeting.
    """
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    named = tuple(dict.fromkeys(c for c, *_ in templates))
    own = [[t for t in templates if t[0] == c] for c in named]
    each = -(-n // len(named)) if n else 1
    found = F.array(*[F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("category", "text", "base", "language"), t, strict=True)]) for t in group]) for group in own])
    rows = spark.range(n).withColumn("_of", F.get(found, F.floor(F.col("id") / each).cast("int")))
    rows = rows.withColumn("t", F.get("_of", F.pmod(F.xxhash64("id", F.lit(seed), F.lit(1)), F.size("_of")).cast("int"))).drop("_of")
    filled = X.fill(
        F.col("t.text"), id=(pick(4, 90_000) + 10_000).cast("string"), amount=_pick(AMOUNTS, pick(5, len(AMOUNTS))), plan_amount=_pick(PLAN_AMOUNTS, pick(6, len(PLAN_AMOUNTS))), period=_pick(PERIODS, pick(7, len(PERIODS))),
        err_code=_pick(ERROR_CODES, pick(8, len(ERROR_CODES))), ip=F.concat(F.lit("192.168."), (pick(9, 254) + 1).cast("string"), F.lit("."), (pick(10, 254) + 1).cast("string")), model=F.concat(F.lit("PRO-"), (pick(11, 900) + 100).cast("string")),
    )
    prefix = F.when(F.col("t.language") == "en", _pick(PREFIXES, pick(2, len(PREFIXES)))).otherwise("")
    suffix = _pick(SUFFIXES, pick(3, len(SUFFIXES)))
    rows = rows.withColumns({"_suffix": suffix, "ticket_text": X.minor_noise(F.concat(prefix, filled, suffix), F.col("id"))})
    rows = rows.select(
        F.format_string("TICK-%06d", F.col("id") + 10001).alias("ticket_id"), "ticket_text", F.col("t.category").alias("category"),
        X.rule_priority(F.col("ticket_text"), F.col("t.base"), F.trim("_suffix")).alias("priority"), F.lit("synthetic").alias("source"),
        F.col("t.language").alias("language"), F.xxhash64("id", F.lit(seed), F.lit(12)).alias("_place"),
    )
    return rows.withColumn("department", X.department(F.col("category"))).orderBy("_place").drop("_place")
