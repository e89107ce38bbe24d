"""Reports on a dataset and its models: each a relation (section, name, value) of a few hundred rows, and a Markdown file made of it.

Everything is aggregated by Spark; what reaches the driver is the rows that a report shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import files
from . import prepare, profile

SECTIONS = "section string, name string, value double"


def row_of(section: str, row: DataFrame) -> DataFrame:
    """The columns of a single row as (section, name, value)."""
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns])).alias("x")
    return row.select(F.lit(section).alias("section"), one).select("section", "x.*")


def counts_of(section: str, rows: DataFrame, name: Column) -> DataFrame:
    """How many rows each name has."""
    return rows.groupBy(F.coalesce(name.cast("string"), F.lit("none")).alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "name", "value")


def together(*parts: DataFrame) -> DataFrame:
    """Sections one after another."""
    return reduce(DataFrame.unionByName, parts)


def diversity(rows: DataFrame, text: str = "ticket_text", keywords: int = 5) -> DataFrame:
    """Lengths, how many texts are short, medium and long, vocabulary, languages, and the commonest words of each category."""
    words = rows.select("category", F.explode(profile.ngrams(F.col(text), 1)).alias("term"))
    top = profile.top_per_group(words, "category", "term", keywords).select(F.lit("keywords").alias("section"), F.concat_ws(": ", "category", "term").alias("name"), F.col("n").cast("double").alias("value"))
    return together(
        row_of("length", profile.length_stats(rows, text)), row_of("buckets", profile.length_buckets(rows, text)), row_of("vocabulary", profile.vocabulary(rows, text)),
        counts_of("language", rows, X.language_by_parts(F.col(text))), top,
    )


def validation(decided: DataFrame) -> DataFrame:
    """Of rows with their ``reasons``: how many pass and fail, and how many miss each rule."""
    status = F.when(F.size("reasons") == 0, "approved").otherwise("rejected")
    told = decided.select(F.explode("reasons").alias("r"))
    return together(row_of("rows", decided.agg(F.count("*").alias("total"))), counts_of("rows", decided, status), counts_of("reasons", told, F.regexp_replace("r", r"[ ]?['(:].*", "")))


def version(raw: DataFrame, cleaned: DataFrame, split: DataFrame) -> DataFrame:
    """A dataset's sizes, distributions and splits, and what its splits share."""
    signed = split.withColumn("pattern", X.signature(F.col("ticket_text")))
    sizes = together(row_of("sizes", raw.agg(F.count("*").alias("raw"))), row_of("sizes", cleaned.agg(F.count("*").alias("cleaned"), F.countDistinct("ticket_text").alias("unique"))))
    shared = [row_of(f"shared by {a} and {b}", prepare.split_overlap(signed, a, b)) for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))]
    return together(sizes, *[counts_of(c, cleaned, F.col(c)) for c in ("source", "category", "priority")], counts_of("split", split, F.col("split")), *shared)


def models(metrics: DataFrame, best: DataFrame) -> DataFrame:
    """Of ``metrics`` (target, model, and a column a measure) each measure, and as 1 the ``best`` (target, model) of each target."""
    measures = [c for c in metrics.columns if c not in ("target", "model", "ord")]
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in measures])).alias("x")
    rows = metrics.select(F.concat(F.lit("models for "), "target").alias("section"), "model", one).select("section", F.concat_ws(": ", "model", "x.measure").alias("name"), "x.value")
    return together(rows, best.select(F.concat(F.lit("best model for "), "target").alias("section"), F.col("model").alias("name"), F.lit(1.0).alias("value")))


def summary(*reports: DataFrame, sections: tuple[str, ...]) -> DataFrame:
    """The named sections of several reports."""
    return together(*reports).where(F.col("section").isin(*sections))


def write(spark: SparkSession, path: str, heading: str, report: DataFrame, limit: int = 5000) -> str:
    """A report as a Markdown file, a table a section in the order of their names; returned as well. Raises ValueError beyond ``limit`` rows."""
    rows = report.orderBy("section", F.desc("value"), "name").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report holds {limit} rows at most; aggregate first")
    show = lambda v: "" if v is None else f"{v:g}" if abs(v) >= 1e15 else f"{v:,.6f}".rstrip("0").rstrip(".")
    safe = lambda t: str(t).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {heading}", ""]
    for i, r in enumerate(rows):
        if i == 0 or rows[i - 1].section != r.section:
            lines += [*([""] if i else []), f"## {safe(r.section)}", "", "| name | value |", "| --- | --- |"]
        lines.append(f"| {safe(r.name)} | {show(r.value)} |")
    text = "\n".join([*lines, ""])
    files.write_text(spark, path, text)
    return text
