"""Ingestion of incoming tickets: row rules with reasons, the acceptance fold, routing and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X
from ..sources import files
from . import fold


def reasons(known_id: Column, known_text: Column) -> Column:
    """Why a row is turned away, in fixed order; empty if it is sound."""
    ticket_id, text = X.strip(F.col("ticket_id")), X.strip(F.col("ticket_text"))
    size = F.length(text)
    has_text = F.coalesce((text != "") & (text != "nan"), F.lit(False))
    found = X.pii(text)
    said = lambda c: F.coalesce(F.col(c), F.lit("nan"))
    quoted = lambda head, c: F.concat(F.lit(f"{head} '"), c, F.lit("'"))
    return F.array_compact(
        F.array(
            F.when(F.coalesce(ticket_id.isin("", "nan"), F.lit(True)), "Missing ticket_id").when(known_id, quoted("Duplicate ticket_id", ticket_id)),
            F.when(~has_text, "Missing or empty ticket_text")
            .when(size < fixed.MIN_INCOMING, F.concat(F.lit("Text too short ("), size.cast("string"), F.lit(f" chars, min {fixed.MIN_INCOMING})")))
            .when(size > fixed.MAX_INCOMING, F.concat(F.lit("Text too long ("), size.cast("string"), F.lit(f" chars, max {fixed.MAX_INCOMING})"))),
            F.when(has_text & known_text, "Exact duplicate ticket_text already in dataset"),
            F.when(has_text & (F.size(found) > 0), F.concat(F.lit("PII detected: "), F.concat_ws(", ", found))),
            F.when(X.title(F.col("category"), fixed.CATEGORIES).isNull(), quoted("Invalid category", said("category"))),
            F.when(X.title(F.col("priority"), fixed.PRIORITIES).isNull(), quoted("Invalid priority", said("priority"))),
            F.when(~F.lower(X.strip(F.coalesce("source", F.lit("external")))).isin(*fixed.SOURCES), quoted("Invalid source", said("source"))),
        )
    )


def validate(rows: DataFrame) -> DataFrame:
    """``rows`` with their reasons by the rules that need no other row."""
    return rows.withColumn("reasons", reasons(F.lit(False), F.lit(False)))


def against_existing(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``rows`` with their reasons, those against an ``existing`` dataset's ids and texts included."""
    ids = existing.select(X.strip(F.col("ticket_id")).alias("_id")).where("_id is not null").distinct().withColumn("_known_id", F.lit(True))
    texts = existing.select(F.lower(X.strip(F.col("ticket_text"))).alias("_text")).where("_text is not null").distinct().withColumn("_known_text", F.lit(True))
    keyed = rows.withColumns(rival_keys())
    marked = keyed.join(ids, "_id", "left").join(texts, "_text", "left")
    told = reasons(F.coalesce("_known_id", F.lit(False)), F.coalesce("_known_text", F.lit(False)))
    return marked.withColumn("reasons", told).drop("_id", "_text", "_known_id", "_known_text")


def rival_keys() -> dict[str, Column]:
    """What makes two rows rivals: the trimmed id, and the trimmed text in any case."""
    return {"_id": X.strip(F.col("ticket_id")), "_text": F.lower(X.strip(F.col("ticket_text")))}


def tagged_keys(rows: DataFrame) -> DataFrame:
    """(key) of each row's id and text, 16 bytes behind a letter that tells which; rows without one have none for it."""
    own = rival_keys()
    return rows.select(F.explode(F.array(_tagged("i", own["_id"]), _tagged("t", own["_text"]))).alias("key")).where("key is not null")


def _tagged(tag: str, key: Column) -> Column:
    return F.concat(F.lit(tag).cast("binary"), fold.short(key))


def against_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` with their reasons, those against ``known`` (key) of :func:`tagged_keys`, each once, included."""
    own = rival_keys()
    marked = rows.withColumns({"_i": _tagged("i", own["_id"]), "_t": _tagged("t", own["_text"])})
    for name in ("_i", "_t"):
        marked = marked.join(known.select(F.col("key").alias(name), F.lit(True).alias(f"{name}_known")), name, "left")
    told = reasons(F.coalesce("_i_known", F.lit(False)), F.coalesce("_t_known", F.lit(False)))
    return marked.withColumn("reasons", told).drop("_i", "_t", "_i_known", "_t_known")


def accept(rows: DataFrame, existing: DataFrame, order: str = "row_ord", bound: int = fold.BOUND) -> DataFrame:
    """``rows`` with validation_status and rejection_reason as if taken one by one in ``order``, after an ``existing`` dataset."""
    return _settle(against_existing(rows, existing), order, bound)


def accept_unknown(rows: DataFrame, known: DataFrame, order: str = "row_ord", bound: int = fold.BOUND) -> DataFrame:
    """As :func:`accept`, after rows of which only the ``known`` keys (:func:`tagged_keys`) are left."""
    return _settle(against_known(rows, known), order, bound)


def _settle(told: DataFrame, order: str, bound: int) -> DataFrame:
    """Rows with the reasons that earlier datasets give, decided in ``order``.

    A sound row is a duplicate only of an *accepted* earlier row with its id or text (:mod:`.fold`); values of ``order`` are unique.
    """
    checked = files.written(told.withColumns(rival_keys()), "checked")
    accepted = fold.first_come(checked.where(F.size("reasons") == 0), order, F.col("_id"), F.col("_text"), bound)
    ids, texts = accepted.select(F.col("_a").alias("_id_key"), F.col("_ord").alias("_id_from")), accepted.select(F.col("_b").alias("_text_key"), F.col("_ord").alias("_text_from"))
    checked = checked.withColumns({"_id_key": fold.short(F.col("_id")), "_text_key": fold.short(F.col("_text"))})
    out = checked.join(ids, "_id_key", "left").join(texts, "_text_key", "left")
    late_id, late_text = F.coalesce(F.col("_id_from") < F.col(order), F.lit(False)), F.coalesce(F.col("_text_from") < F.col(order), F.lit(False))
    known_id = F.exists("reasons", lambda r: r.startswith("Duplicate ticket_id")) | late_id
    known_text = F.exists("reasons", lambda r: r == "Exact duplicate ticket_text already in dataset") | late_text
    out = out.withColumn("reasons", reasons(known_id, known_text))
    status = F.when(F.size("reasons") == 0, "approved").otherwise("rejected")
    return (
        out.withColumns({"source": F.lower(X.strip(F.coalesce("source", F.lit("external")))), "validation_status": status, "rejection_reason": F.concat_ws("; ", "reasons")})
        .drop("_id", "_text", "_id_key", "_text_key", "_id_from", "_text_from", "reasons")
    )


PLACES = ("manual", "external", "rejected")


def write_routed(decided: DataFrame, out: str, batch: int = 0) -> None:
    """Approved rows to ``out``/manual and ``out``/external by source, rejected ones with their reason to ``out``/rejected.

    Each batch has its own folder in all three, written over if it comes again: what a batch has written is what its last
    run decided.
    """
    ok = decided.where("validation_status = 'approved'").drop("rejection_reason")
    parts = (ok.where("source = 'manual'"), ok.where("source <> 'manual'"), decided.where("validation_status = 'rejected'"))
    for place, rows in zip(PLACES, parts, strict=True):
        rows.write.mode("overwrite").parquet(f"{out}/{place}/batch={batch}")


def append_first(old: DataFrame, new: DataFrame, out: str, order: str = "row_ord") -> None:
    """Old and new rows, of equal texts the first, as a new snapshot at ``out``; old rows come first, each side by ``order``."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in ("ticket_text", "_new")]
    first = rows.groupBy("ticket_text").agg(F.min_by(F.struct(*rest), F.struct("_new", order, *[c for c in rest if c != order])).alias("_row"))
    first.select("ticket_text", "_row.*").write.parquet(out)
