"""Document fingerprints by winnowing, in DataFrame operations alone.

Words are maximal runs other than ASCII white space. Every ``k`` consecutive words have a rolling hash, a polynomial
over the words' hashes modulo a prime; of each ``window`` consecutive hashes the least is kept, of equal ones the
rightmost, with its position. Two texts that share a run of at least ``window + k - 1`` words share a fingerprint of it.

A fingerprint entry is one long: 34 bits of hash above 30 bits that count positions down, so that the least entry of
a window is the least hash at the rightmost place. A string of Spark has less than 2**31 bytes and so at most 2**30
words: every place fits.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

PLACE_BITS = 30
PLACES = (1 << PLACE_BITS) - 1
#: The largest prime below 2**34, and the polynomials' base: products stay below 2**62.
PRIME, BASE = (1 << 34) - 41, 0x5851F42
#: Hashes are stored less this, so that the sign bit counts too.
MIDDLE = 1 << 33
CUT = "[\\x20\\x09-\\x0D]+"
#: Rows of a bucket of neighbouring doc_ids, and the code points of a text that order equal doc_ids between buckets.
BUCKET_ROWS, PREFIX = 100_000, 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _from(a: Column, start: int) -> Column:
    """``a`` without its first ``start`` elements."""
    return F.slice(a, F.lit(start + 1), F.size(a))


def _first(a: Column, less: int) -> Column:
    """``a`` without its last ``less`` elements."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - less, F.lit(0)))


def _times(x: Column, n: int) -> Column:
    """A residue times BASE to the power of ``n``, below 2**62; the factor in two parts if it is large."""
    factor = pow(BASE, n, PRIME)
    if factor < 1 << 28:
        return x * F.lit(factor).cast("bigint")
    high, low = (F.lit(v).cast("bigint") for v in (factor >> 17, factor & (1 << 17) - 1))
    return (x * high) % F.lit(PRIME) * F.lit(1 << 17).cast("bigint") + x * low


def _joined(a: Column, b: Column, width: int) -> Column:
    """Hashes of runs from those of their first parts ``a`` and of their last parts ``b``, ``width`` words long."""
    return F.zip_with(a, b, lambda x, y: (_times(x, width) + y) % F.lit(PRIME))


def rolled(words: Column, k: int) -> Column:
    """The rolling hash of every ``k`` consecutive residues: sum of word[i] * BASE ** (k - 1 - i), modulo PRIME.

    Each follows from its left neighbour by taking one word's term out and a new one in. All are made at once: runs of
    2n words join two of n, one more word joins at the end, so ``k`` words cost a step for each binary digit of ``k``.
    """

    def build(runs: Column, width: int, digits: str) -> Column:
        if not digits:
            return runs
        if digits[0] == "0":
            return let(_joined(_first(runs, width), _from(runs, width), width), lambda r: build(r, 2 * width, digits[1:]))
        return let(
            _joined(_first(runs, width), _from(runs, width), width),
            lambda r: let(_joined(_first(r, 1), _from(words, 2 * width), 1), lambda q: build(q, 2 * width + 1, digits[1:])),
        )

    return build(words, 1, bin(k)[3:])


def word_hashes(text: Column) -> Column:
    """A residue for each word, in order."""
    return F.transform(F.filter(F.split(text, CUT), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))


def gram_hashes(text: Column, k: int) -> Column:
    """One residue for each ``k`` consecutive words; with fewer words one for all of them, without words none."""
    return let(
        word_hashes(text),
        lambda h: F.when(F.size(h) >= k, rolled(h, k)).when(F.size(h) > 0, F.array(F.pmod(F.xxhash64(h), F.lit(PRIME)))).otherwise(F.array().cast("array<bigint>")),
    )


def entries(grams: Column) -> Column:
    """Hashes with their places, as one long each."""
    return F.transform(grams, lambda h, i: (h - F.lit(MIDDLE)) * F.lit(1 << PLACE_BITS).cast("bigint") + F.lit(PLACES) - i)


def hash_of(entry: Column) -> Column:
    """The hash of an entry."""
    return F.shiftright(entry, PLACE_BITS) + F.lit(MIDDLE)


def place_of(entry: Column) -> Column:
    """The place of an entry: the number of its first word, from 0."""
    return F.lit(PLACES) - entry.bitwiseAND(F.lit(PLACES))


def _least_of_two(a: Column, step: int) -> Column:
    """The lesser of each entry and the one ``step`` places on."""
    return let(a, lambda x: F.zip_with(_first(x, step), _from(x, step), lambda p, q: F.least(p, q)))


def _least(a: Column, window: int) -> Column:
    """The least of each ``window`` consecutive entries, by doubling."""
    width = 1
    while width < window:
        step = min(width, window - width)
        a = _least_of_two(a, step)
        width += step
    return a


def winnow(text: Column, k: int, window: int) -> Column:
    """The kept entries of a text, in order of place; an empty array without words."""
    return let(
        entries(gram_hashes(text, k)),
        lambda e: F.when(F.size(e) > window, F.array_distinct(_least(e, window))).when(F.size(e) > 0, F.array(F.array_min(e))).otherwise(e),
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared over all distinct hashes of two fingerprints; 1 if both are empty."""
    hashes = lambda e: F.array_distinct(F.transform(e, lambda x: F.shiftright(x, PLACE_BITS)))
    return let(
        hashes(a),
        lambda x: let(
            hashes(b),
            lambda y: let(F.size(F.array_intersect(x, y)), lambda n: F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(n / (F.size(x) + F.size(y) - n))),
        ),
    )


def fingerprint_text(entries_: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits for each entry."""
    return F.array_join(F.transform(entries_, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _order() -> list[Column]:
    """What orders rows between buckets: null doc_ids last, doc_ids descending, of equal ones the start of the text."""
    start = F.hex(F.substring("text", 1, PREFIX).cast("binary"))
    return [F.col("doc_id").isNull().alias("n"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("bigint"))).alias("d"), start.alias("p")]


def _bounds(docs: DataFrame, buckets: int) -> list[dict]:
    """The least key of each of at most ``buckets`` ranges of like size, by Spark's own range partitioning of the keys."""
    keys = docs.select(*_order()).repartitionByRange(buckets, "n", "d", "p")
    least = keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("n", "d", "p")).alias("k")).select("k.*").collect()  # one row per bucket
    return [{"n": n, "d": d, "p": p} for n, d, p in sorted({tuple(r) for r in least})]


def _bucket(bounds: Column, n: int, key: Column) -> Column:
    """How many bounds come before ``key`` or equal it, less one, by bisection."""
    steps = F.lit([1 << i for i in reversed(range(n.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(bounds, at + s - 1) <= key), at + s).otherwise(at))
    return F.greatest(found - 1, F.lit(0))


def _labels(spark: SparkSession, buckets: int) -> list[int]:
    """A number for each bucket, so that the hash of the numbers deals buckets to all shuffle partitions in turn."""
    parts = partitions(spark)
    each = -(-buckets // parts)
    some = spark.range(parts * (2 * each + 40)).select(F.col("id").cast("int").alias("label")).groupBy(F.pmod(F.hash("label"), F.lit(parts)).alias("part"))
    found = some.agg(F.slice(F.array_sort(F.collect_list("label")), 1, each).alias("labels")).orderBy("part").collect()  # a row per partition
    return [r.labels[k] for k in range(each) for r in found if k < len(r.labels)][:buckets]


def with_next(docs: DataFrame, columns: list[str], buckets: int, derive: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``docs`` with what ``derive`` adds, and next_<c> of the row after it in descending doc_id; after the last comes the first.

    ``derive`` works on rows that have been dealt, so that what it adds does not travel.

    Equal doc_ids go by text, null ones last. Rows are dealt into ranges of neighbouring doc_ids, and each range also
    gets the first row of the one after it. So neighbours meet after one shuffle of the rows, ranges are dealt to tasks
    in turn, and the driver holds one key per range. A doc_id, or null, that repeats is split between
    ranges by the first ``PREFIX`` code points of its texts; rows that agree in these too stay together.
    """
    found = _bounds(docs, buckets)
    if not found:
        return derive(docs).withColumns({f"next_{c}": F.col(c) for c in columns})
    n = len(found)
    bounds = F.from_json(F.lit(json.dumps(found)), "array<struct<n:boolean,d:bigint,p:string>>")
    key = F.struct(*_order())
    rows = docs.withColumn("_bucket", _bucket(bounds, n, key)).withColumn("_halo", F.lit(0))
    # The first row of a bucket has the bucket's bound as its key.
    heads = rows.where(F.get(bounds, F.col("_bucket")) == key).groupBy("_bucket").agg(F.min_by(F.struct(*docs.columns), "text").alias("_row"))
    heads = heads.select("_row.*", F.pmod(F.col("_bucket") - 1, F.lit(n)).alias("_bucket"), F.lit(1).alias("_halo"))
    labels = F.from_json(F.lit(json.dumps(_labels(docs.sparkSession, n))), "array<int>")
    window = Window.partitionBy("_label").orderBy("_halo", F.col("doc_id").desc_nulls_last(), "text")
    both = rows.unionByName(heads).withColumn("_label", F.coalesce(F.get(labels, F.col("_bucket")), -1 - F.col("_bucket")))
    both = derive(both.repartition(partitions(docs.sparkSession), "_label"))
    return both.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).where("_halo = 0").drop("_bucket", "_halo", "_label")


def buckets_of(docs: DataFrame) -> int:
    """Ranges for ``docs``: one a shuffle partition, or as many for each that a range has ``BUCKET_ROWS`` rows at most."""
    parts = partitions(docs.sparkSession)
    return parts * max(1, -(-docs.count() // (parts * BUCKET_ROWS)))


def compare_edited(docs: DataFrame, k: int = 3, window: int = 4) -> DataFrame:
    """Fingerprints of every whole text (null: empty), of its edited text, and how like they are.

    The edited text has the last third of the code points replaced by the first as many, or all, of the next
    document's. Repeated rows are compared each; an empty table gives no rows; columns other than doc_id and text
    do not matter. Texts of fewer than ``k`` words have one hash of all their words, empty ones none.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(texts, ["text", "fp"], buckets_of(texts), lambda rows: rows.withColumn("fp", winnow(F.col("text"), k, window)))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.withColumn("edited_fp", winnow(F.col("edited"), k, window))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("fp")).alias("fingerprint"),
        fingerprint_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
