"""First come, first served over two keys, as if rows were taken one by one, without taking them one by one.

Rows are edges between the values of two keys; a row is accepted if no row accepted before it has either value. So an
accepted row depends on earlier rows of its own connected component alone:

1. one round settles every row that is the first of both its values, and all that share a value with it;
2. what is left (chains of rivals) is split into components, and each task folds whole components in order;
3. of components too large for a task, the earliest rows are folded, what they settle is taken out, and it starts anew.

A task never holds more than about ``bound`` rows. A chain of rivals takes no more rounds than any other component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files

#: Rows that one task folds: two sets of as many 16-byte keys.
BOUND = 500_000


def short(key: Column) -> Column:
    """16 bytes for a key; equal for equal keys."""
    return F.unhex(F.md5(key.cast("string").cast("binary")))


def _fold(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen_a, seen_b = set(), set()
    for batch in rows:
        taken = []
        for a, b in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True):
            taken.append(a not in seen_a and b not in seen_b)
            if taken[-1]:
                seen_a.add(a)
                seen_b.add(b)
        yield batch.filter(pa.array(taken, pa.bool_()))


def _folded(rows: DataFrame) -> DataFrame:
    """The accepted ones of rows that no other partition shares a key with."""
    return files.written(rows.sortWithinPartitions("_ord").mapInArrow(_fold, rows.schema), "folded")


def _without(rows: DataFrame, settled: DataFrame) -> DataFrame:
    return rows.join(settled.select("_a"), "_a", "left_anti").join(settled.select("_b"), "_b", "left_anti").select("_ord", "_a", "_b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for edges (u, v); stars grow until none changes."""
    least = lambda rows: rows.groupBy("u").agg(F.min("v").alias("m"))
    link = lambda u, v: F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    pairs = files.written(edges.where("u <> v").select(link(F.col("u"), F.col("v")).alias("e")).select("e.*").distinct(), "edges")
    mark = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        wide = files.written(wide, "edges")
        near = wide.join(least(wide), "u")
        pairs = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        pairs = files.written(pairs, "edges")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _with_root(rows: DataFrame) -> DataFrame:
    """``rows`` with the root of their component and its number of rows."""
    side = lambda c, tag: F.concat(F.lit(tag).cast("binary"), F.col(c))
    roots = components(rows.select(side("_a", "a").alias("u"), side("_b", "b").alias("v")))
    # The least node of a component is one of the first key's, so a value without an entry is its own root.
    found = rows.withColumn("node", side("_a", "a")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    found = files.written(found, "rooted")
    return found.join(found.groupBy("root").agg(F.count("*").alias("_n")), "root")


def first_come(rows: DataFrame, order: str, a: Column, b: Column, bound: int = BOUND) -> DataFrame:
    """_ord, _a, _b of the rows accepted in ``order`` (values that no two rows share): no row accepted before has the same ``a`` or ``b``.

    Rows with a null key are not accepted; nor do they keep others out.
    """
    open_ = files.written(rows.select(F.col(order).alias("_ord"), short(a).alias("_a"), short(b).alias("_b")).where("_a is not null and _b is not null"), "open")
    accepted = [open_.limit(0)]
    while True:
        by_a, by_b = (open_.groupBy(k).agg(F.min("_ord").alias(f"{k}_first")) for k in ("_a", "_b"))
        firsts = open_.join(by_a, "_a").join(by_b, "_b").where("_ord = _a_first and _ord = _b_first").select("_ord", "_a", "_b")
        accepted.append(files.written(firsts, "firsts"))
        open_ = files.written(_without(open_, accepted[-1]), "open")
        n = open_.count()
        if n == 0:
            break
        if n <= bound:
            accepted.append(_folded(open_.coalesce(1)))
            break
        rooted = files.written(_with_root(open_), "sized")
        parts = max(2, -(-2 * n // bound))
        accepted.append(_folded(rooted.where(F.col("_n") <= bound).repartition(parts, "root").select("_ord", "_a", "_b")))
        open_ = rooted.where(F.col("_n") > bound).select("_ord", "_a", "_b")
        if open_.isEmpty():
            break
        accepted.append(_folded(open_.orderBy("_ord").limit(bound).coalesce(1)))
        open_ = files.written(_without(open_, accepted[-1]), "open")
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, accepted)
