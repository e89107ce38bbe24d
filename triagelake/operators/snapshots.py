"""Compaction of the event store: a snapshot of every key's last row, bucketed by key, and the tail of events after it.

The state is the snapshot with the tail's rows laid over it. The snapshot is a bucketed table, so the join that does this moves the tail
alone, cut down to one row a key first; a new snapshot is written the same way, bucket by bucket.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files

#: Rows that a bucket should hold, and the folder of snapshots below the store.
BUCKET_ROWS, FOLDER = 2_000_000, "snapshots"


def pointer(spark: SparkSession, path: str, name: str) -> dict:
    """Where a relation's snapshot is, the sequence number it reaches and its buckets; empty where there is none."""
    return files.read_json(spark, f"{path}/{FOLDER}/{name}.json")


def _table(spark: SparkSession, found: dict, schema: T.StructType) -> DataFrame:
    """The snapshot as a bucketed table, made known to this session's catalogue if it is not yet."""
    if not spark.catalog.tableExists(found["table"]):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"create table `{found['table']}` ({columns}) using parquet clustered by (`{found['key']}`) into {found['buckets']} buckets location '{found['place']}'")
    return spark.table(found["table"])


def merged(snapshot: DataFrame, tail: DataFrame, key: str) -> DataFrame:
    """``snapshot`` (a row a key) with the last row by ``seq`` of each key in ``tail`` (kind, ...) laid over it; deleted keys go."""
    rest = [c for c in tail.columns if c != key]
    order = F.struct("seq", *[c for c in rest if c != "seq"])
    last = tail.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    both = snapshot.join(last, key, "full_outer").where("_row.kind is null or _row.kind <> 'delete'")
    return both.select(*[F.col(key) if c == key else F.when(F.col("_row").isNotNull(), F.col(f"_row.{c}")).otherwise(snapshot[c]).alias(c) for c in snapshot.columns])


def state(spark: SparkSession, path: str, name: str, key: str, events: DataFrame) -> DataFrame | None:
    """The rows that a relation's snapshot and later ``events`` leave; None where there is no snapshot."""
    found = pointer(spark, path, name)
    if not found:
        return None
    schema = T.StructType([f for f in events.schema.fields if f.name != "kind"])
    return merged(_table(spark, found, schema), events.where((F.col("seq") > found["through"]) & F.col(key).isNotNull()), key)


def compact(spark: SparkSession, path: str, name: str, key: str, now: DataFrame, through: int, bucket_rows: int = BUCKET_ROWS, keys: DataFrame | None = None) -> None:
    """Write ``now``, the state up to sequence number ``through``, as the snapshot of a relation. Rows with a null key stay out.

    ``keys``: a frame of as many rows as ``now`` has that costs less to count.

    The number of buckets follows from the rows; a snapshot keeps the last one's, so that nothing of it moves, until it holds four
    times the rows they are meant for. The pointer is written last: a compaction that fails leaves the former snapshot.
    """
    found = pointer(spark, path, name)
    rows = found["rows"] if found else (now if keys is None else keys).count()
    buckets = found["buckets"] if found and rows <= 4 * bucket_rows * found["buckets"] else max(1, -(-rows // bucket_rows))
    version = uuid.uuid4().hex
    table = f"snapshot_{name}_{hashlib.md5(path.encode()).hexdigest()[:8]}_{version[:8]}"
    place = f"{path}/{FOLDER}/{name}-{version}"
    kept = now.where(F.col(key).isNotNull())
    if not found or found["buckets"] != buckets:
        kept = kept.repartition(buckets, key)
    kept.write.format("parquet").bucketBy(buckets, key).option("path", place).saveAsTable(table)
    files.write_json(spark, f"{path}/{FOLDER}/{name}.json", {"table": table, "place": place, "key": key, "buckets": buckets, "through": through, "rows": spark.table(table).count()})
    if found:
        if spark.catalog.tableExists(found["table"]):
            spark.sql(f"drop table `{found['table']}`")
        files.delete(spark, found["place"])


def trim(spark: SparkSession, path: str, name: str) -> int:
    """Delete event files that the snapshot holds all of; how many. Reading the state then opens the tail's files alone."""
    found = pointer(spark, path, name)
    if not found:
        return 0
    events = spark.read.schema("seq long").parquet(f"{path}/{name}")
    spans = events.groupBy("_metadata.file_path").agg(F.max("seq").alias("last")).where(F.col("last") <= found["through"]).collect()  # a row per file
    for r in spans:
        files.delete(spark, r.file_path)
    return len(spans)
