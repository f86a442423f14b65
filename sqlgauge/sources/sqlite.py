"""SQLite files as a Spark source, and their catalogs.

A table is read by row-id ranges, one per task, through Spark's Python data
source interface; files have to lie in a folder that every executor can reach.
Catalogs are read from the file headers in parallel over the files.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sqlgauge.sources.catalog import TABLES_JSON_FIELDS

FORMAT = "sqlite_file"
DEFAULT_PARTITIONS = 8


def _connect(path: str) -> sqlite3.Connection:
    path = path.removeprefix("file://").removeprefix("file:")
    connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    connection.text_factory = bytes
    return connection


def decode(value: object) -> object:
    """Text is UTF-8, else Latin-1; other values pass."""
    if not isinstance(value, bytes):
        return value
    try:
        return value.decode("utf-8")
    except UnicodeDecodeError:
        return value.decode("latin-1")


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def affinity(declared: str) -> str:
    """SQLite's affinity of a declared type; the first rule that applies wins."""
    name = declared.upper()
    rules = {
        "integer": ("INT",),
        "text": ("CHAR", "CLOB", "TEXT"),
        "blob": ("BLOB",),
        "real": ("REAL", "FLOA", "DOUB"),
    }
    found = (kind for kind, parts in rules.items() if any(part in name for part in parts))
    return next(found, "numeric" if name.strip() else "blob")


def spark_type(declared: str, stored: set[str] = frozenset()) -> str:
    """Spark type that holds every cell of a column.

    ``stored`` has SQLite's types of the cells. Declared types only bind empty columns and text:
    SQLite lets any cell hold anything, so a numeric column with text in it is a text column
    here, and one with fractions is a double; no cell is cut or lost.
    """
    kind, stored = affinity(declared), stored - {"null"}
    if kind == "text" or stored & {"text", "blob"} or (kind == "blob" and not stored):
        return "string"
    if stored:
        return "bigint" if stored == {"integer"} and kind != "real" else "double"
    return "bigint" if kind == "integer" else "double"


def _fit(value: object, kind: str) -> object:
    """The cell as its column's type."""
    value = decode(value)
    if value is None:
        return None
    return {"string": str, "bigint": int, "double": float}[kind](value)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict, kinds: list[str]) -> None:
        self.path, self.table = options["path"], options["table"]
        self.wanted = int(options.get("partitions", DEFAULT_PARTITIONS))
        self.kinds = kinds

    def partitions(self) -> list[InputPartition]:
        connection = _connect(self.path)
        try:
            low, high = connection.execute(
                f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}"
            ).fetchone()
        except sqlite3.OperationalError:  # views and tables without row ids
            return [_Range(None, None)]
        finally:
            connection.close()
        if low is None:
            return [_Range(None, None)]
        step = max(1, -(-(high - low + 1) // self.wanted))
        return [_Range(i, min(i + step - 1, high)) for i in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        connection = _connect(self.path)
        sql = f"SELECT * FROM {_quoted(self.table)}"
        bounds: tuple = ()
        if partition.low is not None:
            sql += " WHERE rowid BETWEEN ? AND ?"
            bounds = (partition.low, partition.high)
        try:
            for row in connection.execute(sql, bounds):
                yield tuple(_fit(v, k) for v, k in zip(row, self.kinds))
        finally:
            connection.close()


class SQLiteSource(DataSource):
    """``format("sqlite_file")`` with options ``path``, ``table``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _columns(self) -> list[tuple[str, str]]:
        connection = _connect(self.options["path"])
        try:
            table = _quoted(self.options["table"])
            columns = connection.execute(f"PRAGMA table_info({table})").fetchall()
            found = []
            for _, name, declared, *_ in columns:
                name = decode(name)
                types = connection.execute(f"SELECT DISTINCT typeof({_quoted(name)}) FROM {table}")
                found.append((name, spark_type(decode(declared) or "", {decode(t[0]) for t in types})))
            return found
        finally:
            connection.close()

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self._columns())

    def reader(self, schema) -> SQLiteReader:
        return SQLiteReader(self.options, [kind for _, kind in self._columns()])


def read_sqlite(
    spark: SparkSession, path: str, table: str, partitions: int = DEFAULT_PARTITIONS
) -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    reader = spark.read.format(FORMAT).option("table", table).option("partitions", partitions)
    return reader.option("path", path).load()


def list_tables(path: str) -> list[str]:
    connection = _connect(path)
    try:
        rows = connection.execute("SELECT name FROM sqlite_master WHERE type = 'table'")
        return [decode(r[0]) for r in rows.fetchall()]
    finally:
        connection.close()


def catalog_record(path: str) -> dict:
    """The ``tables.json`` record of one file; composite keys keep all columns."""
    connection = _connect(path)
    tables = list_tables(path)
    columns: list[list[str]] = [["-1", "*"]]
    types, primary, place = ["text"], [], {}
    try:
        for i, table in enumerate(tables):
            for row in connection.execute(f"PRAGMA table_info({_quoted(table)})").fetchall():
                name = decode(row[1])
                place[(table.lower(), name.lower())] = len(columns)
                if row[5]:
                    primary.append(str(len(columns)))
                columns.append([str(i), name])
                types.append(decode(row[2]) or "")
        foreign = []
        for table in tables:
            for row in connection.execute(f"PRAGMA foreign_key_list({_quoted(table)})").fetchall():
                target = decode(row[2])
                source = place.get((table.lower(), decode(row[3]).lower()))
                # Without a named column the key refers to the target's primary key.
                named = decode(row[4])
                keys = [
                    int(p) for p in primary if tables[int(columns[int(p)][0])].lower() == target.lower()
                ]
                end = place.get((target.lower(), named.lower())) if named else (keys or [None])[0]
                if source is not None and end is not None:
                    foreign.append([source, end])
    finally:
        connection.close()
    return {
        "db_id": os.path.basename(path).split(".")[0],
        "table_names": tables,
        "table_names_original": tables,
        "column_names": columns,
        "column_names_original": columns,
        "column_types": types,
        "primary_keys": primary,
        "foreign_keys": foreign,
    }


def sqlite_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of every file below ``root`` (or ``root`` itself) called ``*.sqlite*``.

    Only the listing is read, no contents.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path").where(F.col("path").contains(".sqlite"))


def sqlite_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Catalog records of all SQLite files below ``root``, as ``tables.json`` rows."""
    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [catalog_record(p) for p in frame["path"]]
            yield pd.DataFrame(rows, columns=TABLES_JSON_FIELDS.fieldNames())

    return sqlite_files(spark, root).mapInPandas(records, TABLES_JSON_FIELDS)
