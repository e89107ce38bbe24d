"""Vector code compression: product codes from codebooks that delta-maintained Lloyd rounds fit, in whole numbers.

Vectors become integers, floor(1024 * x), and are cut into equal parts; each part position has a codebook. The state between
rounds is a written table of the integer vectors with their last assignments, and a written table of the running sums and
counts of every entry. A round assigns parts anew in one pass over the state, without a shuffle of vectors. Only parts whose
assignment has changed contribute to the sums, minus where they were and plus where they are now; a task adds its
contributions up, so what is shuffled is one row per entry that a task has changed, and nothing once assignments settle.

Everything is whole numbers, so that the order of additions cannot change an entry: products in double precision where they
are surely exact, Python's integers where they may not be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, materialize

#: Units per 1.0 of a component; and the largest number of labels whose sums are broadcast.
UNITS, LABELS = 1024, 100_000
MOST = (1 << 63) - 1
#: Vectors whose distances to a codebook are held at once.
ROWS = 8192
ROW, DELTA = 0, 1


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def in_units(vector: Column) -> Column:
    """floor(1024 * x) of every component; beyond a long, its nearest long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * UNITS))


@dataclass
class Codebooks:
    """Entries of each part position: a parts x entries x width array of whole numbers."""

    entries: np.ndarray
    largest: int = field(init=False)

    def __post_init__(self) -> None:
        self.largest = max((abs(int(x)) for x in (self.entries.min(initial=0), self.entries.max(initial=0))), default=0)

    def sha256(self) -> str:
        """Digest of all components in decimal, by part, entry and position within the part, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The nearest entry of each part of each vector, ties to the lower index; and the squared distances summed over parts."""
        parts, _, width = self.entries.shape
        codes = np.zeros((len(vectors), parts), np.uint8)
        if not len(vectors) or not width:
            return codes, [0] * len(vectors)
        largest = max(self.largest, abs(int(vectors.min())), abs(int(vectors.max())))
        if 4 * width * largest * largest >= 1 << 53:
            return self._nearest_of_large(vectors, codes)
        error = np.zeros(len(vectors), np.int64)
        for p in range(parts):
            own, book = vectors[:, p * width : (p + 1) * width].astype(np.float64), self.entries[p].astype(np.float64)
            lengths = (book * book).sum(1)
            for a in range(0, len(own), ROWS):
                x = own[a : a + ROWS]
                found = (lengths - 2 * (x @ book.T)).argmin(1)
                codes[a : a + ROWS, p] = found
                away = x - book[found]
                error[a : a + ROWS] += (away * away).sum(1).astype(np.int64)
        return codes, error.tolist()

    def _nearest_of_large(self, vectors: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, list[int]]:
        parts, _, width = self.entries.shape
        book = self.entries.astype(object)
        errors = []
        for i, v in enumerate(vectors.astype(object)):
            total = 0
            for p in range(parts):
                away = book[p] - v[p * width : (p + 1) * width]
                far = (away * away).sum(1)
                codes[i, p] = int(far.argmin())
                total += far[codes[i, p]]
            errors.append(min(total, MOST))
        return codes, errors


def _components(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _contribute(codes: np.ndarray, some: np.ndarray, sign: int, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add, or take away, parts to and from the sums and counts of their entries, those of one entry added up first."""
    if not len(codes):
        return
    order = np.argsort(codes, kind="stable")
    own = codes[order]
    cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    sums[own[cuts]] += sign * np.add.reduceat(some[order].astype(sums.dtype), cuts, axis=0)
    counts[own[cuts]] += sign * np.diff(np.append(cuts, len(own)))


def _round(rows: Iterator[pa.RecordBatch], books: Codebooks, first: bool) -> Iterator[pa.RecordBatch]:
    """Rows with their new assignments, then the task's contributions to the sums."""
    parts, entries, width = books.entries.shape
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    held = 0
    for batch in rows:
        vectors = _components(batch.column("vector"), parts * width)
        codes, _ = books.nearest(vectors)
        if vectors.size:
            held += len(vectors) * max(1, abs(int(vectors.min())), abs(int(vectors.max())))
        if held >= 1 << 62 and sums.dtype != object:
            sums = sums.astype(object)
        before = None if first else np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
        for p in range(parts):
            own = vectors[:, p * width : (p + 1) * width]
            if before is None:
                _contribute(codes[:, p], own, 1, sums[p], counts[p])
            else:
                moved = np.flatnonzero(before[:, p] != codes[:, p])
                _contribute(before[moved, p], own[moved], -1, sums[p], counts[p])
                _contribute(codes[moved, p], own[moved], 1, sums[p], counts[p])
        packed = pa.array([c.tobytes() for c in codes], pa.binary())
        none = lambda kind, n=len(batch): pa.nulls(n, kind)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(batch), ROW, np.int32)), batch.column("vec_id"), batch.column("label"), batch.column("vector"), packed, none(pa.int32()), none(pa.int64()), none(SUMS)], schema=STATE
        )
    changed = np.argwhere((counts != 0) | (sums != 0).any(2))
    n = len(changed)
    total = pa.array([[int(x) for x in sums[p, e]] for p, e in changed.tolist()], SUMS)
    slots = pa.array((changed[:, 0] * entries + changed[:, 1]).astype(np.int32))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, DELTA, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, VECTOR), pa.nulls(n, pa.binary()), slots, pa.array(counts[changed[:, 0], changed[:, 1]]), total], schema=STATE
    )


SUMS, VECTOR = pa.list_(pa.decimal128(38, 0)), pa.list_(pa.int64())
STATE = pa.schema([("what", pa.int32()), ("vec_id", pa.int64()), ("label", pa.string()), ("vector", VECTOR), ("codes", pa.binary()), ("slot", pa.int32()), ("n", pa.int64()), ("total", SUMS)])
STATE_DDL = "what int, vec_id long, label string, vector array<bigint>, codes binary, slot int, n long, total array<decimal(38,0)>"


def prepare(rows: DataFrame, parts: int = 4) -> DataFrame:
    """vec_id, label and the integer vector of the rows that take part, written to the shared folder.

    Empty vectors, and those whose length is not the commonest among those that ``parts`` divides (ties: the longest), take no
    part, as one codebook cannot hold parts of several lengths.
    """
    kept = rows.where(usable(F.col("embedding")))
    sizes = kept.groupBy(F.size("embedding").alias("size")).agg(F.count("*").alias("n")).where((F.col("size") > 0) & (F.col("size") % parts == 0))
    top = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    width = top[0].size if top else 0
    kept = kept.where(F.size("embedding") == width)
    return materialize(kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), in_units(F.col("embedding")).alias("vector")), "vectors")


def _least_ids(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    least = np.empty(0, np.int64)
    for batch in rows:
        least = np.unique(np.append(least, batch.column("vec_id").drop_null().to_numpy(zero_copy_only=False).astype(np.int64)))[:k]
    yield pa.RecordBatch.from_arrays([pa.array(least)], ["vec_id"])


def first_entries(vectors: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors of the smallest vec_ids, ascending; of a vec_id that repeats, the least vector. None without a vec_id."""
    ids = vectors.select("vec_id").mapInArrow(partial(_least_ids, k=entries), "vec_id long").distinct().orderBy("vec_id").limit(entries).collect()
    if not ids:
        return None
    some = vectors.where(F.col("vec_id") <= ids[-1].vec_id).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    least = some.orderBy("vec_id").collect()  # as many as ids
    found = np.array([r.vector for r in least], np.int64)
    width = found.shape[1] // parts
    return Codebooks(found.reshape(len(found), parts, width).transpose(1, 0, 2).copy())


def _updated(books: Codebooks, sums: DataFrame) -> Codebooks:
    """Each entry as the floor of its parts' mean; those of no part stay. ``sums`` has a row per entry at most."""
    entries = books.entries.copy()
    size = entries.shape[1]
    for r in sums.collect():
        if r.n > 0:
            entries[r.slot // size, r.slot % size] = [int(x) // r.n for x in r.total]
    return Codebooks(entries)


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over rows of :func:`prepare`; None without any vec_id. Of 256 entries at most."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte")
    books = first_entries(vectors, parts, entries)
    if books is None:
        return None
    width = books.entries.shape[2]
    state, sums, done = vectors.withColumn("codes", F.lit(None).cast("binary")), None, []
    for number in range(rounds):
        given = state.select("vec_id", "label", "vector", "codes").mapInArrow(partial(_round, books=books, first=number == 0), STATE_DDL)
        both = materialize(given, "assigned")
        deltas = both.where(F.col("what") == DELTA).select("slot", "n", "total")
        if sums is not None:
            deltas = deltas.unionByName(sums)
        columns = [F.sum(F.get("total", F.lit(i))).alias(f"c{i}") for i in range(width)]
        added = deltas.groupBy("slot").agg(F.sum("n").alias("n"), *columns)
        previous, sums = sums, materialize(added.select("slot", "n", F.array(*[F.col(f"c{i}").cast("decimal(38,0)") for i in range(width)]).alias("total")), "sums")
        books = _updated(books, sums)
        for old in done:
            drop_written(old)
        done = [both] if previous is None else [both, previous]
        state = both.where(F.col("what") == ROW)
    for old in [*done, *([sums] if sums is not None else [])]:
        drop_written(old)
    return books


def _encode(rows: Iterator[pa.RecordBatch], books: Codebooks | None) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        if books is None:
            continue
        parts, _, width = books.entries.shape
        codes, errors = books.nearest(_components(batch.column("vector"), parts * width))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])


def encode(vectors: DataFrame, books: Codebooks | None) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and squared error of rows of :func:`prepare`; none without codebooks."""
    return vectors.select("vec_id", "label", "vector").mapInArrow(partial(_encode, books=books), "vec_id long, label string, code string, error long")


def with_label_error(coded: DataFrame, labels: int = LABELS, salts: int = 64) -> DataFrame:
    """``coded`` with label_error, the errors summed over rows of equal label, null being one; beyond a long, the largest long.

    Sums of at most ``labels`` labels are broadcast. More are joined by label and one of ``salts`` numbers, over which a
    label's rows are dealt and its sum is repeated, so that a common label is not one task's.
    """
    total = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = materialize(total.select(F.col("label").alias("_label"), F.least("total", F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error")), "label_errors")
    if sums.count() <= labels:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label")))
    else:
        dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)))
        spread = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = dealt.join(spread, F.col("label").eqNullSafe(F.col("_label")) & (dealt["_salt"] == spread["_salt"])).drop("_salt")
    return joined.drop("_label")


def compress(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of ``rows`` (vec_id, embedding, label) that takes part.

    Rows whose vector is null or holds null or non-finite components are dropped, as are those of another length than most
    (see :func:`prepare`). A null vec_id is coded but starts no entry; of repeated rows each is coded. With fewer vec_ids
    than ``entries`` the codebooks are smaller. An empty table, or one without any vec_id, gives no rows. Other columns do
    not matter.
    """
    vectors = prepare(rows.select("vec_id", "embedding", "label"), parts)
    books = fit(vectors, parts, entries, rounds)
    coded = materialize(encode(vectors, books), "coded")
    drop_written(vectors)
    coded = with_label_error(coded)
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256"))
