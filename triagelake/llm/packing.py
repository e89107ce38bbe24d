"""Shortest-pack-first packing over the length histogram.

Pieces of at most ``max_len`` tokens are counted by length. The histogram has at most ``max_len`` bars however
many documents there are, so packing runs on the driver over counts of identical packs: lengths longest first,
each into the open pack with the fewest tokens, moving whole counts at once. Patterns then return to the pieces
by rank: piece number r of a length takes slot number r of that length.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, small_batches
from .tokenize import batches, encoder

PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def free(total: int, max_len: int) -> bool:
    """Whether a sequence of ``total`` tokens takes no padding."""
    return total == max_len or total & (total - 1) == 0


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a pack, how many such packs)]: every length placed exactly as often as counted.

    Packs are kept as counts by their lengths, grouped by the tokens they hold. The shortest pack that exists is
    the one with most room, so if the piece does not fit there it fits nowhere and opens packs of its own.
    """
    packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    heap: list[int] = []

    def put(total: int, pattern: tuple[int, ...], n: int) -> None:
        if not packs[total]:
            heapq.heappush(heap, total)
        packs[total][pattern] = packs[total].get(pattern, 0) + n

    for length in sorted((k for k, n in counts.items() if n > 0 and k > 0), reverse=True):
        left = counts[length]
        while left:
            while heap and not packs[heap[0]]:
                heapq.heappop(heap)
            if not heap or heap[0] + length > max_len:
                put(length, (length,), left)
                break
            total = heap[0]
            pattern, n = packs[total].popitem()
            used = min(n, left)
            if n > used:
                packs[total][pattern] = n - used
            else:
                if not packs[total]:
                    heapq.heappop(heap)
            put(total + length, (*pattern, length), used)
            left -= used
    return [(p, n) for group in packs.values() for p, n in group.items()]


def pad_of(patterns: list[tuple[tuple[int, ...], int]], max_len: int) -> int:
    """Padding tokens of packs."""
    return sum(n * (max_len - sum(p)) for p, n in patterns if not free(sum(p), max_len))


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of each run of like slots."""
    ranks: dict[int, int] = defaultdict(int)
    out, base = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            out.append((length, ranks[length], ranks[length] + n, base, offset))
            ranks[length] += n
            offset += length
        base += n
    return out


def pack(pieces: DataFrame, max_len: int) -> DataFrame:
    """``pieces`` (doc_id, start, length >= 1 and at most ``max_len``, ...) with sequence_id and offset.

    ``pieces`` is read twice: pass a written table. Ranks come from counts by (length, bucket), so that a length
    with a third of all pieces is spread over as many tasks as there are buckets. Rows of length 0 or null get
    null places. The first ranks, a row for each length and bucket, grow with the buckets and are therefore merged, not
    broadcast: the ranking needs the pieces by length and bucket anyway, so this costs no further shuffle. The slot table
    is broadcast: it has at most a few rows per length, whatever the input's size.
    """
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(partitions(spark))))
    counts = pieces.where("length > 0").groupBy("length", "_b").agg(F.count("*").alias("_n"))
    hist = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most max_len rows
    full = hist.pop(max_len, 0)
    patterns = pack_histogram(hist, max_len)
    slots = spark.createDataFrame(
        [(max_len, 0, full, 0, 0), *((a, b, c, d + full, e) for a, b, c, d, e in _slots(patterns))], "_l long, _from long, _to long, _seq long, offset long"
    )
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "pack-base")
    ranked = (
        pieces.join(base.hint("merge"), ["length", "_b"], "left")
        .withColumn("_r", F.col("_base") + F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "start")) - 1)
        .join(F.broadcast(slots), (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to")), "left")
    )
    return ranked.withColumn("sequence_id", F.col("_seq") + F.col("_r") - F.col("_from")).drop("_b", "_base", "_r", "_l", "_from", "_to", "_seq")


def _pieces(rows: Iterator[pa.RecordBatch], path: str, end_id: int, max_len: int) -> Iterator[pa.RecordBatch]:
    enc, end = encoder(path), struct.pack("<I", end_id)
    for batch in rows:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for some in batches(texts):
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(doc_ids[some], enc.encode_many(texts[some]), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, max_len):
                    part = ids[4 * start : 4 * (start + max_len)]
                    for column, value in zip(out, (doc_id, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def token_pieces(docs: DataFrame, vocabulary: str, max_len: int, end_id: int = 1) -> DataFrame:
    """Every whole ``text`` (null: empty) as ids and ``end_id``, cut into pieces of ``max_len`` and a rest."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(partial(_pieces, path=vocabulary, end_id=end_id, max_len=max_len), PIECES_SCHEMA)


def pack_documents(docs: DataFrame, vocabulary: str, max_len: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece that holds ``end_id`` alone; repeated rows are packed each; columns other
    than doc_id and text do not matter. An empty table gives no rows.
    """
    pieces = materialize(token_pieces(docs, vocabulary, max_len, end_id), "pieces")
    return pack(pieces, max_len).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
