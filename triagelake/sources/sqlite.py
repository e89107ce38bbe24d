"""SQLite files as a Spark source: tables read in ranges of their row numbers, chosen columns and conditions in each range's query.

:func:`read_table`, or ``spark.read.format("sqlite")`` after :func:`register`. The file must be where every executor can open it
(a shared mount), as SQLite has no server; it is opened read-only, so readers do not lock each other out.

Conditions are options of the read. Spark 4.1 would also push a query's filters into a Python source, but it keeps the reader that has
taken them for the frame's next queries, which then miss rows (``rows.where(...).count()``, then ``rows.count()``), so that is not used.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Conditions (column, one of these, value) and the SQL they become.
COMPARED = {"=": "{} = ?", "<>": "{} <> ?", ">": "{} > ?", ">=": "{} >= ?", "<": "{} < ?", "<=": "{} <= ?", "is": "{} is ?", "is not": "{} is not ?", "starts with": "substr({0}, 1, length(?)) = ?", "contains": "instr({}, ?) > 0"}
BATCH = 2000


def _open(path: str) -> sqlite3.Connection:
    local = unquote(urlparse(path).path) if path.startswith("file:") else path
    return sqlite3.connect(f"file:{quote(local)}?mode=ro", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def type_of(declared: str) -> T.DataType:
    """A column's type by SQLite's own rule of affinities; dates and times by their names."""
    d = declared.upper()
    if "INT" in d or "BOOL" in d:
        return T.LongType()
    if "TIMESTAMP" in d or "DATETIME" in d:
        return T.TimestampNTZType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.StringType()


def condition(column: str, how: str, value: object) -> tuple[str, list]:
    """A condition as SQL with its values; raises ValueError for an unknown kind."""
    if how == "in":
        values = list(value)  # type: ignore[call-overload]
        return f"{_name(column)} in ({', '.join('?' * len(values))})", values
    if how not in COMPARED:
        raise ValueError(f"conditions compare by {', '.join([*COMPARED, 'in'])}, not by {how}")
    text = COMPARED[how].format(_name(column))
    return text, [value] * text.count("?")


@dataclass
class Range(InputPartition):
    """Row numbers from ``low`` to below ``high``; None is open."""

    low: int | None
    high: int | None


class SqliteReader(DataSourceReader):
    """Reads the columns of a schema from one table, in ranges, where all conditions hold."""

    def __init__(self, path: str, table: str, schema: T.StructType, partitions: int, where: Sequence[tuple[str, str, object]]) -> None:
        self.path, self.table, self.schema, self.count = path, table, schema, partitions
        made = [condition(*w) for w in where]
        self.clauses, self.values = [c for c, _ in made], [v for _, some in made for v in some]

    def partitions(self) -> list[Range]:
        with _open(self.path) as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_name(self.table)}").fetchone()
        if low is None:
            return [Range(None, None)]
        count = max(1, min(self.count, high - low + 1))
        cuts = [low + (high - low + 1) * i // count for i in range(1, count)]
        # The outer ranges are open: a row that comes after the look at the ends is not lost between them.
        return [Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = list(self.clauses), list(self.values)
        for sign, end in ((">=", partition.low), ("<", partition.high)):
            if end is not None:
                where.append(f"rowid {sign} ?")
                values.append(end)
        text = f"select {', '.join(_name(f.name) for f in self.schema.fields)} from {_name(self.table)}" + (f" where {' and '.join(where)}" if where else "")
        makers = [_maker(f) for f in self.schema.fields]
        db = _open(self.path)
        try:
            rows = db.execute(text, values)
            while some := rows.fetchmany(BATCH):
                for row in some:
                    yield tuple(None if x is None else make(x) for make, x in zip(makers, row, strict=True))
        finally:
            db.close()


def _maker(field: T.StructField):  # noqa: ANN202
    """What turns a value that SQLite holds, of any type, into the column's; raises ValueError where it cannot be one."""
    kinds = {T.LongType: (int,), T.DoubleType: (int, float), T.StringType: (str, int, float), T.BinaryType: (bytes,), T.TimestampNTZType: (str,)}[type(field.dataType)]
    make = {T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes, T.TimestampNTZType: datetime.fromisoformat}[type(field.dataType)]

    def of(x):  # noqa: ANN001, ANN202
        if not isinstance(x, kinds):
            raise ValueError(f"column {field.name} holds {x!r}, which is no {field.dataType.simpleString()}")
        return make(x)

    return of


class SqliteSource(DataSource):
    """Options: path, table, partitions (8), columns (a JSON list; all), where (a JSON list of [column, comparison, value])."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        table = self.options["table"]
        with _open(self.options["path"]) as db:
            found = db.execute("select name, type from pragma_table_info(?)", [table]).fetchall()
        if not found:
            raise ValueError(f"there is no table {table} in {self.options['path']}")
        types = {name: type_of(kind) for name, kind in found}
        chosen = json.loads(self.options.get("columns", "null")) or list(types)
        if missing := [c for c in chosen if c not in types]:
            raise ValueError(f"{table} has no column {', '.join(missing)}")
        return T.StructType([T.StructField(c, types[c]) for c in chosen])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options["path"], self.options["table"], schema, int(self.options.get("partitions", "8")), json.loads(self.options.get("where", "[]")))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SqliteSource)


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 8, columns: Sequence[str] | None = None, where: Sequence[tuple[str, str, object]] = ()) -> DataFrame:
    """The ``columns`` (all) of one table's rows for which all conditions (column, comparison, value) hold; raises where there is no such table.

    Comparisons are SQLite's: =, <>, >, >=, <, <=, is, is not, in, starts with, contains. An empty table gives no rows. Tables without row
    numbers are refused by SQLite.
    """
    register(spark)
    return spark.read.format("sqlite").options(path=path, table=table, partitions=str(partitions), columns=json.dumps(columns), where=json.dumps([list(w) for w in where])).load()
