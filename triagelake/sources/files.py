"""Small files beside the tables, through Spark's file systems: JSON documents, reports, CSV, intermediates."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    system, place = _place(spark, path)
    return system.exists(place)


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder, and those above it, where there is none."""
    system, place = _place(spark, path)
    system.mkdirs(place)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file where there is none; whether this call was the one that did."""
    system, place = _place(spark, path)
    system.mkdirs(place.getParent())
    try:
        return bool(system.createNewFile(place))
    except Exception as error:  # noqa: BLE001  file systems differ in how they say that it is there
        if system.exists(place):
            return False
        raise error


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file or folder to a place where nothing is yet, in one step."""
    system, place = _place(spark, path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
    system.mkdirs(target.getParent())
    if system.exists(target) or not system.rename(place, target):
        raise OSError(f"{path} could not be moved to {to}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all it holds; nothing where there is none."""
    system, place = _place(spark, path)
    system.delete(place, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, whole or not at all: written beside its place and renamed."""
    system, place = _place(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(place, False)
    if not system.rename(beside, place):
        raise OSError(f"{path} could not be written")


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text; raises FileNotFoundError where there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    system, place = _place(spark, path)
    source = system.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(source)).decode()
    finally:
        source.close()


def write_json(spark: SparkSession, path: str, document: Mapping) -> None:
    """A JSON document, indented by four."""
    write_text(spark, path, json.dumps(document, indent=4, ensure_ascii=False, default=str))


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON document; a missing, malformed or other than an object one counts as empty."""
    try:
        found = json.loads(read_text(spark, path))
    except (FileNotFoundError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def merge_json(spark: SparkSession, path: str, key: str, part: Mapping) -> dict:
    """Set ``key`` of a JSON document, keeping the rest, and write it again."""
    document = read_json(spark, path) | {key: dict(part)}
    write_json(spark, path, document)
    return document


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header; quotes, line ends and separators in fields are quoted, null is an empty field."""
    rows.write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def markdown(rows: DataFrame, title: str, note: str = "", limit: int = 1000) -> str:
    """A small frame as a Markdown table below a heading; raises ValueError beyond ``limit`` rows."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report holds {limit} rows at most; aggregate first")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    line = lambda xs: "| " + " | ".join(map(cell, xs)) + " |"
    return "\n".join([f"## {title}", "", *([note, ""] if note else []), line(rows.columns), line("---" for _ in rows.columns), *map(line, found), ""])


def write_report(spark: SparkSession, path: str, sections: Mapping[str, DataFrame], heading: str) -> str:
    """A Markdown report with a table for each section, written and returned."""
    text = "\n".join([f"# {heading}", "", *(markdown(rows, title) for title, rows in sections.items())])
    write_text(spark, path, text)
    return text


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt over the session's cores where a scan gives fewer partitions, as a file of one row group does.

    Larger inputs have partitions enough and are left as they are, so this never shuffles much.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, *keys)


#: Rows that a partition of :func:`dealt` has.
DEALT = 200_000


def dealt(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """``rows`` of a scan in as many partitions as its rows need, at least one a core, so that what follows in a task does not grow with the table.

    Meant for narrow rows whose texts are made from them; the rows are counted from the files' footers.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DEALT))
    return rows if rows.rdd.getNumPartitions() >= parts else rows.repartition(parts, *keys)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="triagelake-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/triagelake/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` written as Parquet to the shared folder and read again: lineage ends here, no executor is needed for it."""
    path = scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
