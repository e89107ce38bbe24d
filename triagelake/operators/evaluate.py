"""Evaluation of predictions: accuracy, per-class and averaged scores, confusion, consistency, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The share of rows where both agree."""
    return rows.agg(F.round(F.avg((F.col(truth) == F.col(predicted)).cast("double")), 6).alias("accuracy"))


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every label in truth or prediction; 0 where a quotient has no ground."""
    one = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    hit = (F.col(truth) == F.col(predicted)).cast("int").alias("hit")
    counts = rows.select(one.alias("x"), hit).select("x.*", "hit").groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("guessed"), F.sum(F.col("t") * F.col("hit")).alias("hits"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumns({"precision": ratio(F.col("hits"), F.col("guessed")), "recall": ratio(F.col("hits"), F.col("support"))})
    out = out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def averages(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Macro averages and averages weighted by support."""
    each = per_class(rows, truth, predicted)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return each.agg(
        *[F.round(F.avg(c), 4).alias(f"macro_{c}") for c in ("precision", "recall", "f1")], *[F.round(weighted(c), 4).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    )


def summary(rows: DataFrame, by: list[str], truth: str, predicted: str) -> DataFrame:
    """``by`` with accuracy, macro_f1, weighted_f1 and rows of each group of predictions, in one pass."""
    one = F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    counts = rows.select(*by, one.alias("x"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")).select(*by, "x.*", "hit")
    counts = counts.groupBy(*by, "label").agg(F.sum("t").alias("support"), F.sum("p").alias("guessed"), F.sum(F.col("t") * F.col("hit")).alias("hits"))
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("guessed")), F.lit(0.0))
    return counts.groupBy(*by).agg(
        F.round(F.sum("hits") / F.sum("support"), 4).alias("accuracy"), F.round(F.avg(f1), 4).alias("macro_f1"), F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 4).alias("weighted_f1"), F.sum("support").alias("rows")
    )


def scores(rows: DataFrame, truth: str, predicted: str) -> dict[str, float]:
    """accuracy, macro_f1, weighted_f1 and rows of one set of predictions."""
    return summary(rows.withColumn("_all", F.lit(0)), ["_all"], truth, predicted).drop("_all").first().asDict()


def report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The classes' scores with both averages below."""
    each = per_class(rows, truth, predicted)
    total = each.agg(F.sum("support").alias("support"), *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")], *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"w_{c}") for c in ("precision", "recall", "f1")])
    line = lambda name, mark: total.select(F.lit(name).alias("label"), *[F.round(f"{mark}_{c}", 4).alias(c) for c in ("precision", "recall", "f1")], "support")
    body = each.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")
    return body.unionByName(line("macro avg", "m")).unionByName(line("weighted avg", "w"))


def misclassified(rows: DataFrame, truth: str, predicted: str, order: str, k: int = 10) -> DataFrame:
    """The first ``k`` rows where truth and prediction differ."""
    return rows.where(~F.col(truth).eqNullSafe(F.col(predicted))).orderBy(order).limit(k)


def consistency(rows: DataFrame, group: str, predicted: str, expected: str) -> DataFrame:
    """Per group: whether all predictions agree, and whether they also are as expected."""
    return rows.groupBy(group).agg((F.countDistinct(predicted) == 1).alias("consistent"), F.bool_and(F.col(predicted) == F.col(expected)).alias("perfect"))


def consistency_score(groups: DataFrame) -> DataFrame:
    """The percentage of perfect groups."""
    return groups.agg(F.round(F.count_if(F.col("perfect")) * 100 / F.count("*"), 4).alias("score"))


def best(metrics: DataFrame, by: str, score: str, order: str) -> DataFrame:
    """Per target the model with the highest score; of equals the one listed first."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.asc(order)))
    return metrics.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def promotion[T](candidate: T, production: T, validation: T, least: float = 0.85) -> T:
    """Whether a candidate may replace production, for numbers or columns: no worse on the holdout, and good enough on validation."""
    return (candidate >= production) & (validation >= least)


def by_language(rows: DataFrame, group: tuple[str, ...], predicted: str, expected: str, languages: tuple[str, ...], labels: tuple[str, ...], least: int = 2) -> DataFrame:
    """:func:`consistency` of groups whose texts are in ``least`` languages or more, and in how many.

    ``lang`` and ``predicted`` are among ``languages`` and ``labels`` (up to 62 each; any other value is an error) or null. A group's
    different values are bits of a number, so a row is aggregated once, for a group, and not once for each value that is counted.
    """

    def different(c: str, values: tuple[str, ...]) -> Column:
        bit = F.when(F.col(c).isNull(), F.lit(None).cast("long"))
        for i, v in enumerate(values):
            bit = bit.when(F.col(c) == v, F.lit(1 << i).cast("long"))
        bit = bit.otherwise(F.raise_error(F.concat(F.lit(f"unlisted {c}: "), F.col(c))).cast("long"))
        return F.coalesce(F.bit_count(F.bit_or(bit)), F.lit(0)).cast("long")

    told = rows.groupBy(*group).agg(different("lang", languages).alias("languages"), (different(predicted, labels) == 1).alias("consistent"), F.bool_and(F.col(predicted) == F.col(expected)).alias("perfect"))
    return told.where(F.col("languages") >= least)


def language_pairs(rows: DataFrame, group: tuple[str, ...], order: str, text: str, one: str, other: str) -> DataFrame:
    """Of each group the first text in either of two languages, where it has both: (``group``, one_text, other_text)."""
    first = lambda lang: F.min_by(F.when(F.col("lang") == lang, F.col(text)), F.when(F.col("lang") == lang, F.col(order)))
    pairs = rows.where(F.col("lang").isin(one, other)).groupBy(*group).agg(first(one).alias("one_text"), first(other).alias("other_text"))
    return pairs.where("one_text is not null and other_text is not null")


def scenarios(rows: DataFrame, template: Column, text: str, expected: str, order: str) -> DataFrame:
    """A scenario for each template: its first text, and the value that most of its rows have (ties: the least)."""
    out = rows.groupBy(template.alias("template")).agg(F.min_by(text, order).alias("text"), F.mode(expected, deterministic=True).alias("expected"))
    return out.select("template", "text", "expected")


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """n / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    every = Window.partitionBy()
    return counts.select(label, F.round(F.sum("n").over(every) / (F.count("*").over(every) * F.col("n")), 8).alias("weight"))


def softmax(margins: dict[str, Column]) -> Column:
    """name -> each margin's share as a percentage, within the row.

    What a lambda refers to is made anew for each of its calls, so each step is bound as the argument of the next: a margin is made once a row.
    """
    shares = lambda e: X.bound(F.aggregate(e, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(e, lambda x: F.round(x / total * 100, 2)))
    of_top = lambda values: X.bound(F.array_max(values), lambda top: X.bound(F.transform(values, lambda m: F.exp(m - top)), shares))
    return F.map_from_arrays(F.array(*map(F.lit, margins)), X.bound(F.array(*margins.values()), of_top))


def scenario_accuracy(rows: DataFrame, expected: str, models: tuple[str, ...]) -> DataFrame:
    """(model, matches, scenarios, accuracy in percent) of the models' columns against what is expected."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col(m) == F.col(expected)).alias("hit")) for m in models])).alias("x")
    out = rows.select(one).select("x.*").groupBy("model").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("matches"), F.count("*").alias("scenarios"))
    return out.withColumn("accuracy", F.round(F.col("matches") * 100 / F.col("scenarios"), 1))


def subset(rows: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """One row: whether all values of ``column`` are among ``allowed``, and how many are not."""
    out = rows.agg(F.countDistinct(F.when(~F.col(column).isin(*allowed), F.col(column))).alias("others"))
    return out.select(F.lit(column).alias("name"), "others", (F.col("others") == 0).alias("is_subset"))
