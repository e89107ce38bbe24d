"""Connected components by alternating large and small stars, every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize


def _least_of(edges: DataFrame) -> DataFrame:
    """Each source's least neighbour or itself; written, so that joining it to a hub's edges can be split."""
    return materialize(edges.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")), "lows")


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lows = _least_of(both)
    return both.join(lows, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct(), lows


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    lows = _least_of(edges)
    near = edges.join(lows, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return near.unionByName(lows.where("src <> low").select("src", F.col("low").alias("dst"))).distinct(), lows


def _all_stars(edges: DataFrame) -> bool:
    """Whether every source has one end, which is no source: then the ends are the components."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (src long, dst long): the least node that links lead to.

    Edges may repeat, point either way or to their own source; null ends count for nothing. Every round keeps the
    components and brings each node nearer to its least; the rounds grow with the logarithm of the longest path.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    rows = edges.where("src is not null and dst is not null and src <> dst")
    now = materialize(rows.select(high.alias("src"), low.alias("dst")).distinct(), "edges")
    while not _all_stars(now):
        for star in (_large, _small):
            out, lows = star(now)
            after = materialize(out, "edges")
            drop_written(lows)
            drop_written(now)
            now = after
    roots = now.select(F.col("dst").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
