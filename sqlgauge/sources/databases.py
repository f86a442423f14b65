"""Databases in folders: ``<root>/<db_id>/`` with Parquet tables or a SQLite file."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sqlgauge.sources.sqlite import list_tables, read_sqlite

Loader = Callable[[SparkSession], DataFrame]


def _parquet(path: str) -> Loader:
    return lambda spark: spark.read.parquet(path)


def _sqlite(path: str, table: str) -> Loader:
    return lambda spark: read_sqlite(spark, path, table)


def folder_databases(root: str) -> dict[str, dict[str, Loader]]:
    """Loaders per database and table. Only names are looked at."""
    found: dict[str, dict[str, Loader]] = {}
    for db_id in sorted(os.listdir(root)):
        folder = os.path.join(root, db_id)
        if not os.path.isdir(folder):
            continue
        tables: dict[str, Loader] = {}
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if name.endswith(".parquet"):
                tables[name.removesuffix(".parquet")] = _parquet(path)
            elif ".sqlite" in name:
                tables.update({t: _sqlite(path, t) for t in list_tables(path)})
        if tables:
            found[db_id] = tables
    return found


def load_all(
    spark: SparkSession, databases: dict[str, dict[str, Loader]]
) -> dict[str, dict[str, DataFrame]]:
    """The tables as frames of one session."""
    return {
        db: {name: load(spark) for name, load in tables.items()}
        for db, tables in databases.items()
    }
