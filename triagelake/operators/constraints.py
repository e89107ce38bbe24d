"""What the store's relations demand of a row, checked set-wise at append; violations are told, row by row.

Required columns by expressions, references by a left join to the keys that are there, uniqueness by joins to these keys
and, within the batch, by the acceptance fold: a row is turned away only by a row that was let in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import fold, store


@dataclass(frozen=True)
class Demands:
    """Columns that must not be null; two sets of columns that are unique; column -> (relation, column) that it refers to."""

    required: tuple[str, ...]
    unique: tuple[tuple[str, ...], tuple[str, ...]]
    references: tuple[tuple[str, str, str], ...] = ()


# The demands of the store's relations.
DEMANDS = {
    "agents": Demands(("name", "department", "is_active"), (("id",), ("name", "department"))),
    "tickets": Demands(("ticket_id", "ticket_text", "category", "priority", "department", "confidence"), (("id",), ("ticket_id",)), (("assigned_agent_id", "agents", "id"),)),
    "priority_feedback": Demands(("feedback_id", "ticket_id", "original_priority", "corrected_priority"), (("id",), ("feedback_id",))),
}


def _key(columns: tuple[str, ...]) -> Column:
    """One text for several columns; null if one of them is."""
    return F.when(F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False)), None).otherwise(F.to_json(F.struct(*columns)))


def violations(rows: DataFrame, name: str, there: dict[str, DataFrame], order: str = "seq", keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` with ``violation``, why a row cannot be let in after those that are ``there`` (relation -> rows), else null.

    Rows are taken in ``order``, values that no two of them share. The first demand in the order required, references,
    unique that a row misses is told. Null keys are unique. ``keep``: the columns beside ``order`` that are wanted, all
    unless named; others do not travel.
    """
    demands = DEMANDS[name]
    kept = list(rows.columns) if keep is None else [order, *[c for c in keep if c != order]]
    needed = list(dict.fromkeys([*kept, *[c for c, *_ in demands.references]]))
    missing = F.coalesce(*[F.when(F.col(c).isNull(), f"NOT NULL constraint failed: {name}.{c}") for c in demands.required])
    rows = rows.select(*needed, missing.alias("violation"), *[_key(columns).alias(f"_key{i}") for i, columns in enumerate(demands.unique)])
    told = [F.col("violation")]
    for column, relation, key in demands.references:
        known = there[relation].select(F.col(key).alias(column), F.lit(True).alias(f"_has_{column}")).where(F.col(column).isNotNull()).distinct()
        rows = rows.join(known, column, "left")
        told.append(F.when(F.col(column).isNotNull() & F.col(f"_has_{column}").isNull(), f"FOREIGN KEY constraint failed: {name}.{column}"))
    for i, columns in enumerate(demands.unique):
        known = there[name].select(_key(columns).alias(f"_key{i}"), F.lit(True).alias(f"_taken{i}")).where(F.col(f"_key{i}").isNotNull()).distinct()
        rows = rows.join(known, f"_key{i}", "left")
    keys = [f"_{what}{i}" for what in ("key", "taken") for i in range(2)]
    rows = files.written(rows.withColumn("violation", F.coalesce(*told)).select(*kept, "violation", *keys), "demands")
    # A null key keeps nobody out: it stands for itself in the fold.
    own = lambda i: F.coalesce(f"_key{i}", F.concat(F.lit("null "), F.col(order).cast("string")))
    let_in = fold.first_come(rows.where("violation is null and _taken0 is null and _taken1 is null"), order, own(0), own(1))
    unique = ["UNIQUE constraint failed: " + ", ".join(f"{name}.{c}" for c in columns) for columns in demands.unique]
    # Only rows that nothing has settled yet meet those that were let in.
    settled = F.col("violation").isNotNull() | F.col("_taken0").isNotNull()
    done, rest = rows.where(settled).withColumn("violation", F.coalesce("violation", F.lit(unique[0]))), rows.where(~settled)
    why = []
    for i, message in enumerate(unique):
        holder = let_in.select(F.col(f"_{'ab'[i]}").alias(f"_short{i}"), F.col("_ord").alias(f"_holder{i}"))
        rest = rest.withColumn(f"_short{i}", fold.short(own(i))).drop(f"_key{i}").join(holder, f"_short{i}", "left").drop(f"_short{i}")
        why.append(F.when(F.col(f"_taken{i}").isNotNull() | F.coalesce(F.col(f"_holder{i}") < F.col(order), F.lit(False)), message))
    return done.select(*kept, "violation").unionByName(rest.withColumn("violation", F.coalesce(*why)).select(*kept, "violation"))


def append_checked(rows: DataFrame, path: str, name: str) -> DataFrame:
    """Append the ``rows`` (seq, ...) that meet all demands; the others, with their ``violation``, are returned."""
    spark: SparkSession = rows.sparkSession
    relations = {name, *[r for _, r, _ in DEMANDS[name].references]}
    checked = files.written(violations(rows, name, {r: store.state(spark, path, r, "id" if r == "agents" else store.KEYS[r]) for r in relations}), "checked")
    store.append(checked.where("violation is null").drop("violation"), path, name)
    return checked.where("violation is not null")


def without_agents(tickets: DataFrame, gone: DataFrame) -> DataFrame:
    """Tickets after agents (id) were deleted: those that had one of them have none."""
    lost = gone.select(F.col("id").alias("assigned_agent_id"), F.lit(True).alias("_gone")).distinct()
    kept = F.when(F.col("_gone").isNull(), F.col("assigned_agent_id"))
    return tickets.join(lost, "assigned_agent_id", "left").withColumn("assigned_agent_id", kept).select(*tickets.columns)
