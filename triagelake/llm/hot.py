"""Hot tokens: those with so many postings that they would make the partition of their hash uneven.

A packed exchange deals postings by token. A token in a third of all documents has a third as many postings as there are
documents, all in one partition; with many partitions that is far more than the others hold. Such tokens are found first,
on a sample of about ``SAMPLE`` documents a partition, and their postings dealt by token and owner. The sample decides only
where postings go: the operators treat a hot token by rules that hold wherever its postings are, so results do not depend
on it.

A token counts as hot from ``SHARE`` of a partition's mean load on. As the loads add up, there are at most partitions /
``SHARE`` hot tokens, whatever the data: that bounds what the driver gets and every task is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import NONE, Hot
from .common import materialize, partitions, partitions_for
from .worker import release

SAMPLE, SHARE = 64, 0.5
#: Sampled units that a hot token is found in at least: fewer say nothing.
LEAST = 8


def _counted(batches: Iterator[pa.RecordBatch], tokens_of: Callable[[list], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Tokens with the units that hold them, and one row with the units of each batch."""
    release()
    for batch in batches:
        tokens, n = np.unique(tokens_of(batch.column(0).to_pylist()), return_counts=True)
        columns = [pa.array([*tokens.view(np.int64).tolist(), None], pa.int64()), pa.array([*n.tolist(), 0], pa.int64()), pa.array([0] * len(n) + [batch.num_rows], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["token", "n", "units"])


def share_of(texts: DataFrame) -> float:
    """The share of ``texts`` to sample: about ``SAMPLE`` a partition, all if there are fewer."""
    total = texts.count()
    return min(1.0, SAMPLE * partitions_for(texts) / total) if total else 0.0


def find(units: DataFrame, tokens_of: Callable[[list], np.ndarray], distinct: bool = False, parts: int = 0) -> Hot:
    """The hot tokens by sampled ``units`` (one column); ``tokens_of`` gives the 64-bit tokens of a list of units, each unit's own once.

    ``distinct``: equal units post their tokens once, so they count once. ``parts``: of the exchange; the session's setting.
    """
    seen = materialize((units.distinct() if distinct else units).mapInArrow(partial(_counted, tokens_of=tokens_of), "token long, n long, units long"), "token-counts")
    postings, sampled = (x or 0 for x in seen.agg(F.sum("n"), F.sum("units")).first())
    least = max(LEAST, SHARE * postings / (parts or partitions(units.sparkSession)))
    if least > sampled:  # no token stands in so many units
        return NONE
    rows = seen.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()  # at most parts / SHARE
    return Hot(np.array([r.token for r in rows], np.int64).view(np.uint64), np.array([r.n / sampled for r in rows], np.float64))


def find_in(texts: DataFrame, tokens_of: Callable[[list], np.ndarray], distinct: bool = False) -> Hot:
    """The hot tokens of ``texts`` (one column), by a sample of them."""
    share = share_of(texts)
    if not share:
        return NONE
    return find(texts.sample(False, share, seed=20) if share < 1 else texts, tokens_of, distinct, partitions_for(texts))
