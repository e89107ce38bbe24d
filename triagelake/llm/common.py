"""What the operators of this subpackage share: the shared folder, written intermediates, table access."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import scratch, spread


_INNER: ContextVar[str] = ContextVar("inner", default="")


@contextmanager
def apart(tag: str) -> Iterator[str]:
    """Everything that is written meanwhile goes to a folder of its own, whose name :func:`clear_shared` takes."""
    name = f"{tag}-{uuid.uuid4().hex}"
    token = _INNER.set(name)
    try:
        yield name
    finally:
        _INNER.reset(token)


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``, the folder that driver and executors share.

    Only where that setting is absent a local session (tests, a single machine) gets a folder of its own; a cluster must name one.
    """
    inner = f"{_INNER.get()}/" if _INNER.get() else ""
    return scratch(spark, f"{inner}{tag}")


def clear_shared(spark: SparkSession, inner: str = "") -> None:
    """Delete what this application has written to the shared folder, or what was written :func:`apart`; frames read from it are then void."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/triagelake/{spark.sparkContext.applicationId}/{inner}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Seconds between collections that are asked for, and when the last was.
COLLECT_S, _collected = 0.5, [0.0]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends here.

    A lost executor then costs no more than the stage in hand. Shuffle files that only the
    written plan used become garbage; a driver collection, every ``COLLECT_S`` seconds at most, lets Spark's cleaner delete them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    schema = df.schema
    del df
    if time.monotonic() - _collected[0] > COLLECT_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected[0] = time.monotonic()
    return spark.read.schema(schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame of :func:`materialize` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(rows: DataFrame, wish: str) -> str:
    """``wish``, underscored until no column of ``rows`` has that name in any case."""
    taken = {c.lower() for c in rows.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def partitions(spark: SparkSession) -> int:
    """The number of partitions for exchanges: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of input, as its files hold it, for a partition of an exchange that a task takes into memory.
PARTITION_BYTES = 128 << 20


def partitions_for(rows: DataFrame) -> int:
    """Partitions for an exchange whose size follows from ``rows``: the session's setting, or more where they are many.

    What a task holds is then bounded by ``PARTITION_BYTES`` of the input, whatever the setting; the size is the plan's own
    estimate, which for files is what they hold. Results do not depend on the number.
    """
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # a frame made from local rows has no estimate
    return max(partitions(rows.sparkSession), -(-size // PARTITION_BYTES) if known else 0)


#: Bytes of rows that go to a Python worker in one Arrow batch, unless one row has more.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches to ``BATCH_BYTES``, or less if it has less.

    The setting by rows lets 10,000 texts into one batch; JVM and worker then hold tens of MB of it, several times over, in
    memory beside the heap that is not all given back. It is read when a plan runs, so it stays set. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, dealt over the cores where it is one small file."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
