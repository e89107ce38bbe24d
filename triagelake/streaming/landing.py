"""The landing folder as a stream: each batch is validated against what earlier batches accepted, and routed.

The ids and texts accepted so far are keyed state in Spark's state store, maps of keys by hash, an entry a key. A batch asks
the state for its own distinct keys alone, so its cost follows from its rows, not from what has been accepted before. The keys that a batch accepts go to a
folder of their own, which the stream reads back as a second source: that is how they enter the state. What the state has
not taken in yet, the last batch's keys as a rule, is read from that folder directly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import ingest
from ..sources import files
from ..sources.tickets import INCOMING, is_landed

KEYS = "key binary, batch long"
#: The folder of accepted keys, and the record of how far the state has taken them in, below the stream's output.
ACCEPTED, RECORD = "keys", "stream.json"
ANSWERS = "key binary, known boolean, batch long"
#: Maps that the keys are dealt to: a call of the state's function for each that a batch meets, not for each key.
MAPS = 4096
#: Maps need a store with column families.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _numbered(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their place in their file; a file with line ends in fields is one task's, so its rows come in order."""
    passed: dict[str, int] = {}
    for batch in rows:
        line = np.empty(len(batch), np.int64)
        for i, name in enumerate(batch.column("file_name").to_pylist()):
            line[i] = passed.get(name, 0)
            passed[name] = int(line[i]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(line)], [*batch.schema.names, "line"])


def _distinct(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's distinct keys, so that a common key meets the state a few times at most."""
    for batch in rows:
        yield pa.RecordBatch.from_arrays([batch.column("key").unique()], ["key"])


class Known(StatefulProcessor):
    """Tells the keys that were accepted before, and those that come as accepted, with their batch, which are remembered.

    A key that is asked for in the batch it comes in is told at least once; one that is not known has no row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._keys = handle.getMapState("keys", "key binary", "accepted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ANN001, ARG002, N802, N803
        for row in rows:
            if row.batch is not None:
                self._keys.updateValue((row.key,), (True,))
                yield Row(key=row.key, known=True, batch=row.batch)
            elif self._keys.containsKey((row.key,)):
                yield Row(key=row.key, known=True, batch=None)


def take(rows: DataFrame, number: int, out: str, answers: DataFrame | None = None, through: int = -1) -> None:
    """One batch: rows with ``file_name`` and ``line`` (else as they come), in this order decided against the batches before it, and written under its number.

    ``answers`` (key, known) come from the state, which holds the batches up to ``through``; later ones are read from
    the folder of accepted keys. A batch that comes again, after a crash between its writes too, is decided as the
    first time and replaces what it left.
    """
    spark = rows.sparkSession
    if "line" not in rows.columns:
        rows = rows.withColumn("line", F.monotonically_increasing_id())
    known = spark.createDataFrame([], KEYS).select("key")
    if answers is not None:
        known = known.unionByName(answers.where("known").select("key"))
    for earlier in range(through + 1, number):
        if files.exists(spark, f"{out}/{ACCEPTED}/{earlier}"):
            known = known.unionByName(spark.read.schema(KEYS).parquet(f"{out}/{ACCEPTED}/{earlier}").select("key"))
    rows = rows.withColumn("row_ord", F.struct("file_name", "line")).drop("file_name", "line")
    decided = files.written(ingest.accept_unknown(rows, known.distinct()).drop("row_ord"), "decided")
    ingest.write_routed(decided, out, number)
    keys = ingest.tagged_keys(decided.where("validation_status = 'approved'")).select("key", F.lit(number).cast("long").alias("batch"))
    if not files.exists(spark, f"{out}/{ACCEPTED}/{number}") and not keys.isEmpty():
        # Whole or not at all, and never again: the stream must not see files that go away.
        beside = f"{out}/being-written/{uuid.uuid4().hex}"
        keys.write.parquet(beside)
        files.rename(spark, beside, f"{out}/{ACCEPTED}/{number}")


def _take_both(got: DataFrame, number: int, out: str) -> None:
    spark = got.sparkSession
    got = files.written(got, "batch")
    rows, answers = got.where("line is not null").drop("key", "known", "batch"), got.where("line is null").select("key", "known", "batch")
    record = {int(k): v for k, v in files.read_json(spark, f"{out}/{RECORD}").items()}
    before = max((v for k, v in record.items() if k < number), default=-1)
    through = max(before, answers.agg(F.max("batch")).first()[0] or 0) if not answers.where("batch is not null").isEmpty() else before
    if not rows.isEmpty():
        take(rows, number, out, answers, through)
    files.write_json(spark, f"{out}/{RECORD}", {**{k: v for k, v in record.items() if k == number - 1}, number: through})


def ingest_stream(spark: SparkSession, landing: str, out: str, checkpoint: str) -> StreamingQuery:
    """Take all waiting CSV files of ``landing`` but processed and rejected ones: approved rows to ``out``/manual and
    /external, others to ``out``/rejected, each below the batch's number."""
    files.make_folder(spark, f"{out}/{ACCEPTED}")
    spark.conf.set(*STORE)
    source = spark.readStream.schema(INCOMING).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("pathGlobFilter", "*.csv").csv(landing)
    source = source.select("*", "_metadata.file_name").where(is_landed(F.col("file_name")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    rows = source.mapInArrow(_numbered, f"{fields}, line long")
    asked = ingest.tagged_keys(source).select("key").mapInArrow(_distinct, "key binary").withColumn("batch", F.lit(None).cast("long"))
    told = spark.readStream.schema(KEYS).option("recursiveFileLookup", True).parquet(f"{out}/{ACCEPTED}")
    dealt = asked.unionByName(told).withColumn("map", F.pmod(F.xxhash64("key"), F.lit(MAPS)))
    answers = dealt.groupBy("map").transformWithState(Known(), ANSWERS, "append", "none")
    both = rows.unionByName(answers, allowMissingColumns=True)
    return both.writeStream.foreachBatch(lambda got, number: _take_both(got, number, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
