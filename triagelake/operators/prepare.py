"""Data preparation: cleaning, deduplication, template masking and a split that keeps templates whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X

SHARES = {"train": 0.70, "validation": 0.15}


def clean_rows(raw: DataFrame) -> DataFrame:
    """Rows with a text, a listed category and a listed priority, the domains written as listed, the text trimmed."""
    rows = raw.na.drop(subset=["ticket_text", "category", "priority"]).withColumns(
        {"ticket_text": X.strip(F.col("ticket_text")), "category": X.title(F.col("category"), fixed.CATEGORIES), "priority": X.title(F.col("priority"), fixed.PRIORITIES)}
    )
    return rows.where("ticket_text <> '' and category is not null and priority is not null")


def keep_first(rows: DataFrame, key: str = "ticket_text", order: str = "row_ord") -> DataFrame:
    """The first row of each ``key``: one aggregation, so equal keys are combined before they are shuffled."""
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return first.select(key, "_row.*").select(*rows.columns)


def numbered(rows: DataFrame, order: str = "row_ord") -> DataFrame:
    """New ids T00001, … in row order.

    Ranks come from counts by range of ``order``, so that no task sees more than a range.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    cuts = F.lit(sorted(set(bounds))).cast("array<bigint>")
    rows = rows.withColumn("_range", F.size(F.filter(cuts, lambda b: b < F.col(order))))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(order)) + F.col("_base")
    return rows.join(F.broadcast(base), "_range").withColumn("ticket_id", F.format_string("T%05d", rank)).drop("_range", "_base")


def with_pattern(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``pattern`` of their text, unless they have it."""
    return rows if "pattern" in rows.columns else rows.withColumn("pattern", X.signature(F.col("ticket_text")))


def pattern_splits(rows: DataFrame, seed: str = "42") -> DataFrame:
    """(pattern, category, split): of each category's patterns, shuffled by hash, 70 % train, 15 % validation, the rest test.

    Ranks come from counts by category and the first digits of the hash, 4,096 parts a category, so no task ranks a
    whole category. A pattern's category is its first row's. Every category has a pattern to train on, and one to validate on if there are two.
    """
    patterns = with_pattern(rows).groupBy("pattern").agg(F.min_by("category", "row_ord").alias("category"))
    hashed = patterns.withColumn("h", F.md5(F.concat("pattern", F.lit(seed)))).withColumn("part", F.substring("h", 1, 3))
    counts = hashed.groupBy("category", "part").agg(F.count("*").alias("c"))
    by = Window.partitionBy("category")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("category", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(by).alias("n"))
    rank = F.row_number().over(Window.partitionBy("category", "part").orderBy("h", "pattern")) + F.col("base")
    ranked = hashed.join(counts, ["category", "part"]).withColumn("rank", rank)
    train = F.greatest(F.lit(1), F.bround(F.col("n") * SHARES["train"], 0).cast("int"))
    held = F.greatest(F.lit(1), F.bround(F.col("n") * SHARES["validation"], 0).cast("int"))
    ranked = ranked.withColumns({"train": train, "held": held})
    return ranked.select(
        "pattern", "category", F.when(F.col("rank") <= F.col("train"), "train").when(F.col("rank") <= F.col("train") + F.col("held"), "validation").otherwise("test").alias("split")
    )


def with_split(rows: DataFrame, seed: str = "42") -> DataFrame:
    """``rows`` with the split of their pattern; original ids stay. A ``pattern`` that is there already is taken as it is, and stays."""
    splits = pattern_splits(rows, seed).select("pattern", "split")
    return with_pattern(rows).join(splits, "pattern").select(*rows.columns, "split")


def pair_overlaps(named: DataFrame) -> DataFrame:
    """(a, b, n): distinct lower-cased, trimmed texts that two sets share; ``named`` has set_name and ticket_text."""
    texts = named.select("set_name", F.lower(F.trim("ticket_text")).alias("t")).where("t is not null").distinct()
    a, b = texts.select(F.col("set_name").alias("a"), "t"), texts.select(F.col("set_name").alias("b"), "t")
    return a.join(b, "t").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def split_overlap(rows: DataFrame, a: str = "train", b: str = "test") -> DataFrame:
    """One row: distinct patterns, raw texts, and lower-cased and trimmed texts that two splits share.

    Texts are made distinct first, and patterns made of those, where ``rows`` have none.
    """
    sides = [F.max(F.col("split") == s).alias(f"_{i}") for i, s in enumerate((a, b))]
    kept = ["ticket_text", *(["pattern"] if "pattern" in rows.columns else [])]
    texts = with_pattern(rows.where(F.col("split").isin(a, b)).groupBy(*kept).agg(*sides))
    kinds = {"shared_patterns": F.col("pattern"), "shared_texts": F.col("ticket_text"), "shared_normal": F.lower(F.trim("ticket_text"))}
    own = {k: F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in kinds.items()}
    # A text is one row by now, so whether it is shared is known.
    own["shared_texts"] = F.when(F.col("_0") & F.col("_1"), own["shared_texts"])
    one = F.explode(F.array_compact(F.array(*own.values()))).alias("x")
    both = texts.select("_0", "_1", one).select("x.*", "_0", "_1").groupBy("kind", "v").agg(F.max("_0").alias("_0"), F.max("_1").alias("_1")).where("_0 and _1")
    return both.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def shared_passages(docs: DataFrame, items: DataFrame, length: int = 13) -> DataFrame:
    """Distinct (item_id, doc_id) that share a run of ``length`` words, or all words of a shorter item.

    Words are lower-cased runs other than white space, so line ends do not matter; runs are compared by 64-bit hashes.
    """
    hashed = lambda rows, key: rows.select(key, F.transform(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("w"))
    windows = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(F.slice("w", i + 1, n))))
    wanted = hashed(items, "item_id").withColumn("n", F.least(F.size("w"), F.lit(length))).where("n > 0")
    sizes = sorted(r.n for r in wanted.select("n").distinct().collect())  # at most ``length`` numbers
    runs = lambda rows, key, of: rows.select(key, F.explode(F.array_distinct(of)).alias("run"))
    none = F.array().cast("array<bigint>")
    of_items = F.coalesce(*[F.when(F.col("n") == n, windows(n)) for n in sizes], none)
    of_docs = F.concat(none, *[F.coalesce(windows(n), none) for n in sizes])
    return runs(hashed(docs, "doc_id"), "doc_id", of_docs).join(runs(wanted, "item_id", of_items), "run").select("item_id", "doc_id").distinct()


def version_summary(raw: DataFrame, cleaned: DataFrame, split: DataFrame) -> DataFrame:
    """One row of counts and distributions of a dataset's version."""

    def histogram(column: str) -> DataFrame:
        counts = cleaned.groupBy(column).count()
        return counts.agg(F.concat_ws(", ", F.array_sort(F.collect_list(F.concat(column, F.lit("="), F.col("count").cast("string"))))).alias(f"{column}_distribution"))

    sizes = split.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_size") for s in ("train", "validation", "test")])
    out = raw.agg(F.count("*").alias("total_raw")).crossJoin(cleaned.agg(F.count("*").alias("total_cleaned"), F.countDistinct("ticket_text").alias("unique_records")))
    for one in (histogram("source"), histogram("category"), histogram("priority"), sizes):
        out = out.crossJoin(one)  # single rows
    return out


def version_record(raw: DataFrame, cleaned: DataFrame, split: DataFrame, version: str, timestamp: str) -> dict:
    """A dataset's version as one document: counts, distributions, split sizes, and what the splits share; a few rows reach the driver."""
    spread_ = lambda c: {r[c]: r.n for r in cleaned.groupBy(c).agg(F.count("*").alias("n")).orderBy(c).collect()}
    sizes = {r.split: r.n for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()}
    signed = split.withColumn("pattern", X.signature(F.col("ticket_text")))
    pairs = {f"{a}_{b}": split_overlap(signed, a, b).first().asDict() for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))}
    return {
        "version": version, "timestamp": timestamp, "total_raw": raw.count(), "total_cleaned": cleaned.count(), "unique_records": cleaned.select("ticket_text").distinct().count(),
        "source_distribution": spread_("source"), "category_distribution": spread_("category"), "priority_distribution": spread_("priority"),
        "splits": {s: sizes.get(s, 0) for s in ("train", "validation", "test")}, "leakage": pairs,
    }
