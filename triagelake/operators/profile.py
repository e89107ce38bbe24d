"""Profiles: distributions, crosstabs, lengths, vocabulary, n-grams and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as X


def shares(rows: DataFrame, column: str) -> DataFrame:
    """Each value's count and percentage."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 4))


def crosstab(rows: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of ``column``'s values by ``row``, zeros filled in."""
    return rows.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def margins(rows: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of both, of either and of all; a margin is named All."""
    cube = rows.cube(row, column).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = lambda c, bit: F.when(F.col("g").bitwiseAND(bit) != 0, "All").otherwise(F.col(c)).alias(c)
    return cube.select(named(row, 2), named(column, 1), "n")


def grid(rows: DataFrame, row: str, rows_of: tuple[str, ...], column: str, columns_of: tuple[str, ...]) -> DataFrame:
    """A count for every cell of two fixed lists."""
    cells = rows.sparkSession.createDataFrame([(a, b) for a in rows_of for b in columns_of], f"{row} string, {column} string")
    counts = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    return cells.join(counts, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def length_stats(rows: DataFrame, text: str) -> DataFrame:
    """Mean, least, most and median of words and characters."""
    sized = rows.select(F.size(X.words(F.col(text))).alias("words"), F.length(text).alias("chars"))
    out = []
    for c in ("words", "chars"):
        out += [F.round(F.avg(c), 6).alias(f"mean_{c}"), F.min(c).cast("long").alias(f"min_{c}"), F.max(c).cast("long").alias(f"max_{c}"), F.percentile(c, 0.5).alias(f"median_{c}")]
    return sized.agg(*out)


def length_buckets(rows: DataFrame, text: str, short: int = 6, medium: int = 20) -> DataFrame:
    """How many texts are short, medium and long, in words."""
    n = F.size(X.words(F.col(text)))
    return rows.agg(F.count_if(n <= short).alias("short"), F.count_if((n > short) & (n <= medium)).alias("medium"), F.count_if(n > medium).alias("long"))


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """Tokens, distinct tokens and their ratio."""
    all_ = rows.select(F.explode(X.tokens(X.clean(F.col(text)))).alias("t"))
    out = all_.agg(F.count("*").alias("total_tokens"), F.countDistinct("t").alias("unique_tokens"))
    return out.withColumn("ttr", F.round(F.when(F.col("total_tokens") > 0, F.col("unique_tokens") / F.col("total_tokens")).otherwise(0.0), 8))


def top_per_group(counted: DataFrame, group: str, term: str, k: int) -> DataFrame:
    """The ``k`` most frequent terms of each group, ties by term; ``counted`` has one row per occurrence."""
    counts = counted.groupBy(group, term).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.asc(term)))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def ngrams(text: Column, n: int) -> Column:
    """The n-grams of two-letter and longer words, stop words taken out before neighbours are joined."""
    own = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[a-z]{2,}$") & ~t.isin(*fixed.NGRAM_STOP_WORDS))
    if n == 1:
        return own
    joined = F.transform(F.array(own), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.filter(F.get(joined, F.lit(0)), lambda g: F.size(F.split(g, " ")) == n)


def gaps(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Per column: nulls, blanks and rows beyond each value's first."""
    tall = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    out = tall.groupBy("name").agg(F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.trim("v") == "").alias("blanks"), F.count("*").alias("rows"))
    distinct = tall.groupBy("name", "v").count().groupBy("name").agg(F.count("*").alias("kinds"))
    return out.join(distinct, "name").select("name", "nulls", "blanks", (F.col("rows") - F.col("kinds")).alias("duplicates"))


def extremes(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first shortest and the first longest text, in words."""
    n = F.size(X.words(F.col(text)))
    return rows.agg(F.min_by(text, F.struct(n, F.col(order))).alias("shortest"), F.max_by(text, F.struct(n, -F.col(order))).alias("longest"))


def keyword_profile(rows: DataFrame, text: str, words: tuple[str, ...] = fixed.TARGET_WORDS) -> DataFrame:
    """Per target word: texts that hold it, and their commonest priority and category, ties to the lesser."""
    own = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"))
    hits = rows.select(F.explode(F.array_intersect(own, F.array(*map(F.lit, words)))).alias("word"), "priority", "category")
    found = hits.groupBy("word").agg(
        F.count("*").alias("n"), F.mode("priority", deterministic=True).alias("priority"), F.mode("category", deterministic=True).alias("category")
    )
    all_ = rows.sparkSession.createDataFrame([(w,) for w in words], "word string")
    none = lambda c: F.coalesce(c, F.lit("None")).alias(f"dominant_{c}")
    return all_.join(found, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), none("priority"), none("category"))


def keyword_values(rows: DataFrame, text: str, words: tuple[str, ...] = fixed.TARGET_WORDS) -> DataFrame:
    """(word, field, value, n): how the priorities and categories of the texts with each target word are spread."""
    own = F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+"))
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("priority", "category")])).alias("x")
    hits = rows.select(F.explode(F.array_intersect(own, F.array(*map(F.lit, words)))).alias("word"), "priority", "category").select("word", one)
    return hits.groupBy("word", "x.field", "x.value").agg(F.count("*").alias("n"))


def surplus(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(kind, n): rows beyond the first that agree in all of ``columns``, and in each of them."""
    kinds = [("row", columns), *((c, (c,)) for c in columns)]
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.to_json(F.struct(*cs)).alias("v")) for k, cs in kinds])).alias("x")
    counts = rows.select(one).select("x.*").groupBy("kind", "v").agg(F.count("*").alias("c"))
    return counts.groupBy("kind").agg(F.sum(F.col("c") - 1).alias("n"))


def drift(rows: DataFrame, column: str, a: str = "train", b: str = "test") -> DataFrame:
    """How far each value's percentage in split ``a`` is from that in split ``b``."""
    per = rows.where(F.col("split").isin(a, b)).groupBy(column, "split").agg(F.count("*").alias("n"))
    pct = per.withColumn("pct", F.col("n") * 100 / F.sum("n").over(Window.partitionBy("split")))
    wide = pct.groupBy(column).agg(*[F.coalesce(F.max(F.when(F.col("split") == s, F.col("pct"))), F.lit(0.0)).alias(s) for s in (a, b)])
    return wide.select(column, F.round(F.abs(F.col(a) - F.col(b)), 6).alias("drift"))
