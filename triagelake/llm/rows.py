"""Rows to the partition of their doc_id, as compressed Arrow blocks beside packed postings."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .words import mix
from .worker import release

SCHEMA = "part int, kind int, data binary"
ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
ROWS, POSTINGS = 0, 1
#: Bytes of rows that :func:`pack_rows` cuts into blocks at once.
TOGETHER = 24 << 20


def home(owners: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each doc_id."""
    return blocks.target(mix(owners.astype(np.uint64)), parts)


def together(batches: Iterator[pa.RecordBatch], least: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``least`` bytes or more, so that the blocks of many partitions are no smaller for small batches."""
    held: list[pa.RecordBatch] = []
    size = 0

    def joined() -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            held[:] = pa.Table.from_batches(held).combine_chunks().to_batches()
        while held:
            yield held.pop(0)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
            if size >= least:
                yield from joined()
                size = 0
    yield from joined()


def pack_rows(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows as blocks; those with a null doc_id go by their text, as nothing comes to meet them."""
    release()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in together(batches):
        ids = batch.column("doc_id")
        to = home(ids.fill_null(0).to_numpy(zero_copy_only=False), parts)
        for i in np.flatnonzero(np.asarray(ids.is_null())):
            to[i] = zlib.crc32((batch.column("text")[int(i)].as_py() or "").encode("utf-8", "surrogatepass")) % parts
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], to[order][1:] != to[order][:-1])))
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            part = batch.take(pa.array(order[a:b]))
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([int(to[order[a]])], pa.int32()), pa.array([ROWS], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=ARROW)


def meet(docs: DataFrame, postings: DataFrame, parts: int) -> DataFrame:
    """Rows and postings of the same doc_ids in the same partitions."""
    from functools import partial

    rows = docs.mapInArrow(partial(pack_rows, parts=parts), SCHEMA)
    return rows.unionByName(postings.withColumn("kind", F.lit(POSTINGS))).repartitionById(parts, "part")


class Postings:
    """The short tokens of each owner of a partition."""

    def __init__(self, owners: np.ndarray, short: np.ndarray) -> None:
        order = np.lexsort((short, owners))
        self.owners, self.short = owners[order], short[order]

    def of(self, owner: int) -> np.ndarray:
        """Sorted tokens of a doc_id."""
        a, b = np.searchsorted(self.owners, np.array([owner], np.int64).view(np.uint64)[0], "left"), np.searchsorted(self.owners, np.array([owner], np.int64).view(np.uint64)[0], "right")
        return self.short[a:b]


def arrivals(batches: Iterator[pa.RecordBatch], width: int) -> tuple[Postings, list[bytes]]:
    """What has come to a partition: its postings, and its row blocks, still compressed."""
    release()
    owners, short, held = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], []
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data"), strict=True):
            raw = data.as_buffer().to_pybytes()
            if kind == ROWS:
                held.append(raw)
            else:
                o, _, counts, s, _ = blocks.decode(raw, width)
                owners.append(np.repeat(o, counts))
                short.append(s)
    return Postings(np.concatenate(owners), np.concatenate(short)), held


def unpack_rows(held: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The rows of compressed blocks, one block at a time."""
    for raw in held:
        yield from pa.ipc.open_stream(raw)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values
