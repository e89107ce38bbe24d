"""Token-ID output: length-delimited binary records with masked checksums, and a separate offset index.

A file is one run of frames, one frame a document, closed by a single newline byte that no length
counts. A frame is

    uint64 length of the payload | uint32 masked CRC of those 8 bytes | payload | uint32 masked CRC of it

all little-endian. A payload is ``int64 doc_id | uint8 null flag | uint8 bytes per id | uint32 number of
ids | ids``; ids take two bytes where the vocabulary allows it. The first frame of a file holds, in place
of a document, ``b"TLKR" | uint32 partition | uint32 chunk``; files in (partition, chunk) order hold the
documents in ascending doc_id, nulls first. Masking rotates the CRC-32 right by 15 bits and adds a constant,
so that a checksum stored in checksummed data stays harmless.

Writing goes through Spark's text writer, reading through its binary reader: files reach any store that
Spark reaches, and a task that is lost and run again commits once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions
from .tokenize import batches, encoder

MAGIC = b"TLKR"
MASK_ADD = 0xA282EAD8
HEAD, TAIL = 12, 4
#: Code points of a text by which rows of one doc_id are dealt.
PREFIX = 16
INDEX_SCHEMA = "part int, chunk int, record int, doc_id long, offset long, length long, n_tokens long, before long, ids_crc32 long, path string"


def masked(data: bytes | memoryview) -> int:
    """The masked CRC-32 of ``data``."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_ADD) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """``payload`` with its length and both checksums."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(offset, payload) of each frame of a file; raises ValueError where a checksum fails."""
    view, at, end = memoryview(data), 0, len(data) - 1
    while at < end:
        (length,) = struct.unpack_from("<Q", view, at)
        if struct.unpack_from("<I", view, at + 8)[0] != masked(view[at : at + 8]):
            raise ValueError(f"the length at byte {at} is damaged")
        payload = view[at + HEAD : at + HEAD + length]
        if len(payload) != length or struct.unpack_from("<I", view, at + HEAD + length)[0] != masked(payload):
            raise ValueError(f"the record at byte {at} is damaged")
        yield at, payload
        at += HEAD + length + TAIL
    if at != end:
        raise ValueError("the file ends within a record")


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """A document's payload; ``ids``: little-endian unsigned 32-bit."""
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return struct.pack("<qBBI", doc_id or 0, doc_id is None, width, len(ids) // width) + ids


def ids_of(payload: bytes | memoryview) -> tuple[int | None, np.ndarray]:
    """(doc_id, ids as unsigned 32-bit) of a payload."""
    doc_id, null, width, n = struct.unpack_from("<qBBI", payload)
    ids = np.frombuffer(payload, f"<u{width}", n, struct.calcsize("<qBBI"))
    return (None if null else doc_id), ids.astype("<u4", copy=False)


def _chunks(rows: Iterator[pa.RecordBatch], path: str, end_id: int, chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    end = struct.pack("<I", end_id)
    part, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

    def packed() -> pa.RecordBatch:
        head = frame(MAGIC + struct.pack("<II", part, chunk))
        return pa.RecordBatch.from_arrays([pa.array([b"".join([head, *held])], pa.binary())], ["data"])

    for batch in rows:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for some in batches(texts):
            for doc_id, ids in zip(doc_ids[some], enc.encode_many(texts[some]), strict=True):
                held.append(frame(payload_of(doc_id, ids + end, width)))
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield packed()
                    chunk, held, size = chunk + 1, [], 0
    if held:
        yield packed()


def write_records(docs: DataFrame, out: str, vocabulary: str, end_id: int = 1, chunk_bytes: int = 16 << 20) -> None:
    """Encode every whole ``text`` of ``docs`` (null: empty), append ``end_id``, and write record files to ``out``.

    Documents are range-partitioned by doc_id, so files in order hold them in ascending doc_id; a file holds
    ``chunk_bytes`` and at most one document more. Repeated doc_ids stand side by side in the order of their texts, null
    texts first, and null doc_ids before all others; such a run is split between partitions by the texts' beginnings.
    """
    start = F.substring("text", 1, PREFIX)
    ranged = docs.select("doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id", start).sortWithinPartitions("doc_id", "text")
    chunks = ranged.mapInArrow(partial(_chunks, path=vocabulary, end_id=end_id, chunk_bytes=chunk_bytes), "data binary")
    chunks.select(F.col("data").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(out)


def _entries(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
    for batch in rows:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found, part, chunk, before = [], 0, 0, 0
            for record, (offset, payload) in enumerate(frames(data.as_py())):
                if not record:
                    part, chunk = struct.unpack_from("<II", payload, len(MAGIC))
                    continue
                doc_id, ids = ids_of(payload)
                found.append((part, chunk, record - 1, doc_id, offset, len(payload), len(ids), before, zlib.crc32(ids.tobytes()), path))
                before += len(ids)
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*found, strict=True)), strict=True)) if found else {n: [] for n in names}, _arrow_schema())


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in INDEX_SCHEMA.split(", "))])


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of record files: where it stands, its counts and checksum, all read from the files.

    ``before``: ids of the same file before it. Every checksum is verified.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_entries, INDEX_SCHEMA)


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Write the offset index of record files as Parquet beside them and return it."""
    scan_records(spark, path).write.parquet(index)
    return spark.read.parquet(index)


def with_starts(index: DataFrame) -> DataFrame:
    """``index`` with ``start``: ids of all documents before, over files in order.

    Only one row per file meets in one task, never documents.
    """
    per_file = index.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("in_file"))
    order = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_file = per_file.withColumn("file_start", F.coalesce(F.sum("in_file").over(order), F.lit(0)))
    return index.join(per_file.drop("in_file"), ["part", "chunk"]).withColumn("start", F.col("file_start") + F.col("before"))


def _fetch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for data, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            view = memoryview(data.as_buffer())
            got = [ids_of(view[w["offset"] + HEAD : w["offset"] + HEAD + w["length"]]) for w in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w["place"] for w in wanted], pa.int64()), pa.array([d for d, _ in got], pa.int64()), pa.array([i.tolist() for _, i in got], pa.list_(pa.int64()))],
                ["place", "doc_id", "ids"],
            )


def shuffled_read(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """(place, doc_id, ids) of every record; ascending ``place`` is a pseudo-random order that ``seed`` fixes."""
    wanted = index.select("path", F.struct(F.xxhash64("part", "chunk", "record", F.lit(seed)).alias("place"), "offset", "length").alias("w"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.join(wanted.groupBy("path").agg(F.collect_list("w").alias("w")), "path").select("content", "w").mapInArrow(_fetch, "place long, doc_id long, ids array<long>")
