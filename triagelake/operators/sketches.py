"""Profiles as sketches that are kept and merged: distinct texts and templates, and quantiles of lengths.

Counting distinct texts anew reads and shuffles all of them. Here each batch (a day, a source) leaves one small row of sketches;
any union of batches is answered from these rows. HyperLogLog counts have a standard error of about 0.8 % at 2**14 slots
and are exact for small counts; a KLL quantile's rank is off by 1.33 % at most, with 99 % confidence, at k = 200.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SLOTS, K = 14, 200
#: What tests and :func:`checked` allow: four standard errors of a count, and twice the stated error of a rank.
COUNT_ERROR, RANK_ERROR = 0.035, 0.0266


def sketch(rows: DataFrame, *by: str, text: str = "ticket_text") -> DataFrame:
    """A row for each group of ``by``: n, sketches of its texts, templates, and word and character counts.

    Null texts count in n alone.
    """
    sized = rows.select(*by, F.col(text).alias("_text"), X.audit_signature(F.col(text)).alias("_template"), F.size(X.words(F.col(text))).cast("long").alias("_words"), F.length(text).cast("long").alias("_chars"))
    there = lambda c: F.when(F.col("_text").isNotNull(), F.col(c))
    marked = lambda c: F.concat(F.lit("="), there(c))  # noqa: E731  as the sketch passes over empty texts
    return sized.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(marked("_text"), SLOTS).alias("texts"), F.hll_sketch_agg(marked("_template"), SLOTS).alias("templates"),
        F.kll_sketch_agg_bigint(there("_words"), K).alias("words"), F.kll_sketch_agg_bigint("_chars", K).alias("chars"),
    )


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """Rows of :func:`sketch` put together by ``by``, all of them without it."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("texts").alias("texts"), F.hll_union_agg("templates").alias("templates"), F.kll_merge_agg_bigint("words", K).alias("words"), F.kll_merge_agg_bigint("chars", K).alias("chars")
    )


def keep(rows: DataFrame, path: str, *by: str) -> None:
    """Add the sketches of a batch to those kept at ``path``; a batch that comes again is merged again, which changes its n alone."""
    sketch(rows, *by).write.mode("append").parquet(path)


def estimates(sketches: DataFrame, *by: str) -> DataFrame:
    """(``by``, n, texts, templates, near_duplicates, median_words, median_chars) that sketches tell; medians are null without a text."""
    told = merge(sketches, *by)
    median = lambda c: F.when(F.kll_sketch_get_n_bigint(c) > 0, F.kll_sketch_get_quantile_bigint(c, F.lit(0.5)))
    out = told.select(*by, "n", F.hll_sketch_estimate("texts").alias("texts"), F.hll_sketch_estimate("templates").alias("templates"), median("words").alias("median_words"), median("chars").alias("median_chars"))
    return out.withColumn("near_duplicates", F.col("n") - F.col("templates"))


def exact(rows: DataFrame, by: str, text: str = "ticket_text") -> DataFrame:
    """The same counts, counted."""
    sized = rows.select(by, F.col(text).alias("_text"), F.when(F.col(text).isNotNull(), X.audit_signature(F.col(text))).alias("_template"))
    return sized.groupBy(by).agg(F.count("*").alias("n"), F.countDistinct("_text").alias("texts"), F.countDistinct("_template").alias("templates"))


def checked(rows: DataFrame, sketches: DataFrame, by: str, text: str = "ticket_text") -> DataFrame:
    """The counted values of each group and whether what its sketches tell is as near as it should be."""
    told = estimates(sketches, by).select(by, *[F.col(c).alias(f"_{c}") for c in ("n", "texts", "templates", "median_words", "median_chars")])
    near = lambda c: F.abs(F.col(f"_{c}") - F.col(c)) <= F.ceil(COUNT_ERROR * F.col(c))
    sizes = rows.join(F.broadcast(told), by).select(by, "_median_words", "_median_chars", F.size(X.words(F.col(text))).alias("w"), F.length(text).alias("c")).where("c is not null")
    # The median's rank: at most half and a little lie below it, and at least half less a little up to it.
    half = lambda size, m: (F.avg((F.col(size) < F.col(m)).cast("double")) <= 0.5 + RANK_ERROR) & (F.avg((F.col(size) <= F.col(m)).cast("double")) >= 0.5 - RANK_ERROR)
    ranks = sizes.groupBy(by).agg(half("w", "_median_words").alias("words_near"), half("c", "_median_chars").alias("chars_near"))
    counted = exact(rows, by, text).join(told, by)
    return counted.select(by, "n", "texts", "templates", (F.col("_n") == F.col("n")).alias("n_same"), near("texts").alias("texts_near"), near("templates").alias("templates_near")).join(ranks, by, "left")
