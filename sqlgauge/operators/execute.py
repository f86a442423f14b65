"""Guarded execution of query text: time limit, cancellation, structured errors.

Planning a query needs the driver; the work of each query runs on the executors.
Many statements go through ``operators.batch``, a window of them in one job. Only
timing runs statements one after the other.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.functions.dialect import (
    DIALECT_FUNCTIONS,
    DIALECT_SETTINGS,
    any_value_of,
    to_spark_sql,
)
from sqlgauge.operators import batch
from sqlgauge.operators.scoring import result_match
from sqlgauge.session import delete_on_exit, file_bytes, shared_folder, task_count

Loader = Callable[[SparkSession], DataFrame]
Lookups = tuple[tuple[str, str], ...]  # (table, column) by which rows are looked up
TIMEOUT_SECONDS = 30.0
PREVIEW_ROWS = 10
VES_ITERATIONS = 100
_FLUSH_ROWS = 2000
_COPY_BYTES = 1 << 20  # of a table's files, for each file of a copy
_MOST_FILES = 2048


def parquet_tables(folder: str, names: Iterable[str]) -> dict[str, Loader]:
    """Loaders of ``<folder>/<name>.parquet``."""
    def loader(name: str) -> Loader:
        return lambda spark: spark.read.parquet(f"{folder}/{name}.parquet")

    return {name: loader(name) for name in names}


@dataclass
class Outcome:
    """Result of one guarded run. ``condition`` is Spark's error class, if any."""

    ok: bool
    value: object = None
    error: str | None = None
    condition: str | None = None
    seconds: float = field(default=0.0, compare=False)


class Executor:
    """Runs query text against registered databases, one session per database."""

    def __init__(
        self,
        spark: SparkSession,
        databases: dict[str, dict[str, Loader]],
        timeout: float = TIMEOUT_SECONDS,
        parallelism: int = 4,
    ) -> None:
        self.spark = spark
        self.databases = databases
        self.timeout = timeout
        self.parallelism = parallelism
        self._lock = threading.Lock()
        self._session = lru_cache(maxsize=None)(self._open)

    def opened(self, db_id: str, by: Lookups = ()) -> tuple[SparkSession, set[str], set[str]]:
        """Session of a database, its names and integer columns; tables in ``by`` are copies of :meth:`_copied`."""
        with self._lock:
            return self._session(db_id, by)

    def _open(self, db_id: str, by: Lookups) -> tuple[SparkSession, set[str], set[str]]:
        if db_id not in self.databases:
            raise KeyError(f"unknown database: {db_id}")
        session = self.spark.newSession()
        for key, value in DIALECT_SETTINGS.items():
            session.conf.set(key, value)
        for key in ("spark.sql.shuffle.partitions",):
            session.conf.set(key, self.spark.conf.get(key))
        for statement in DIALECT_FUNCTIONS:
            session.sql(statement)
        names: set[str] = set()
        integers: set[str] = set()
        floats: set[str] = set()
        for table, load in self.databases[db_id].items():
            df = load(session)
            column = dict(by).get(table)
            if column:
                self._copied(df, table, column)
            else:
                df.createOrReplaceTempView(table)
            names.add(table.lower())
            for f in df.schema.fields:
                names.add(f.name.lower())
                whole = isinstance(f.dataType, T.IntegralType)
                (integers if whole else floats).add(f.name.lower())
        return session, names, integers - floats

    def tables(self, db_id: str) -> dict[str, DataFrame]:
        session = self.opened(db_id)[0]
        return {table: session.table(table) for table in self.databases[db_id]}

    @staticmethod
    def _copied(df: DataFrame, table: str, column: str) -> None:
        """A view of a copy in the shared folder that is dealt into files by ``column``.

        A statement that compares the column with a number reads one of the files: Spark sees to that.
        """
        session, name = df.sparkSession, f"sqlgauge_{uuid.uuid4().hex}"
        path = f"{shared_folder(session)}/by-column-{uuid.uuid4().hex}"
        n = min(_MOST_FILES, max(task_count(session), -(-file_bytes(df) // _COPY_BYTES)))
        dealt = df.repartition(n, column).write.bucketBy(n, column).sortBy(column)
        dealt.option("path", path).saveAsTable(name, format="parquet")
        delete_on_exit(session, path)
        session.table(name).createOrReplaceTempView(table)
        session.sql(f"DROP TABLE {name}")  # the name; files stay, and so does the view

    def query(self, db_id: str, sql: str, by: Lookups = ()) -> DataFrame:
        """Analysed DataFrame of one statement, with SQLite's leniency about
        select lists that name ungrouped columns."""
        session, names, integers = self.opened(db_id, by)
        text = to_spark_sql(sql, names, integers)
        while True:  # each round wraps one more column
            try:
                return session.sql(text)
            except PySparkException as error:
                if error.getCondition() not in ("MISSING_AGGREGATION", "MISSING_GROUP_BY"):
                    raise
                column = (error.getMessageParameters() or {}).get("expression", "").strip('"')
                wrapped = any_value_of(text, column) if column else None
                if wrapped is None or wrapped == text:
                    raise
                text = wrapped

    # --- one statement -----------------------------------------------------

    def guarded(self, work: Callable[[], object], timeout: float | None = None) -> Outcome:
        """Run ``work`` in a thread of its own and cancel its jobs when time is up."""
        context = self.spark.sparkContext
        tag = f"guarded-{uuid.uuid4().hex}"
        limit = self.timeout if timeout is None else timeout

        def tagged() -> object:
            context.addJobTag(tag)
            try:
                return work()
            finally:
                context.removeJobTag(tag)

        pool = ThreadPoolExecutor(max_workers=1)
        start = time.perf_counter()
        future = pool.submit(tagged)
        try:
            outcome = Outcome(True, future.result(timeout=limit))
        except FutureTimeout:
            context.cancelJobsWithTag(tag)
            outcome = Outcome(False, error="Execution timeout", condition="TIMEOUT")
        except PySparkException as error:
            outcome = Outcome(False, error=str(error), condition=error.getCondition())
        except Exception as error:  # any failure of a query is an outcome, not a crash
            outcome = Outcome(False, error=str(error), condition=type(error).__name__)
        finally:
            pool.shutdown(wait=False)
        outcome.seconds = time.perf_counter() - start
        return outcome

    def check(self, db_id: str, sql: str) -> Outcome:
        """Run to completion on the executors, returning no rows."""
        return self.guarded(
            lambda: self.query(db_id, sql).write.format("noop").mode("overwrite").save()
        )

    def preview(self, db_id: str, sql: str, rows: int = PREVIEW_ROWS) -> Outcome:
        """The first rows, as tuples; stops as soon as it has them."""
        return self.guarded(lambda: [tuple(r) for r in self.query(db_id, sql).take(rows)])

    def matches(self, db_id: str, predicted: str, gold: str) -> Outcome:
        """1 if both statements return the same set of rows, else 0."""
        def work() -> int:
            pair = result_match(self.query(db_id, predicted), self.query(db_id, gold))
            return pair.first()["res"]

        return self.guarded(work)

    # --- many statements ---------------------------------------------------

    def check_all(self, drafts: DataFrame, rows: int | None = PREVIEW_ROWS) -> DataFrame:
        """(sql_idx, ok, message, condition) of drafts (sql_idx, db_id, predicted_sql).

        ``message`` is the error, or the first ``rows`` rows of the result (all, if None).
        """
        return batch.check_all(self, drafts, rows)

    def evaluate(self, pairs: DataFrame) -> DataFrame:
        """(sql_idx, res, condition) of pairs (sql_idx, db_id, predicted_sql, gold_sql).

        A missing prediction, an error and a time-out count as 0.
        """
        return batch.evaluate(self, pairs)

    def _collect_outcomes(self, rows: Iterable, schema: str, name: str) -> DataFrame:
        """Append outcome rows in batches to a table in the shared folder."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        held: list = []
        self.spark.createDataFrame([], schema).write.parquet(path)
        for row in rows:
            held.append(row)
            if len(held) >= _FLUSH_ROWS:
                self.spark.createDataFrame(held, schema).write.mode("append").parquet(path)
                held = []
        if held:
            self.spark.createDataFrame(held, schema).write.mode("append").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _seconds(self, db_id: str, sql: str) -> float:
        start = time.perf_counter()
        self.query(db_id, sql).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def time_pairs(self, pairs: DataFrame, iterations: int = VES_ITERATIONS) -> DataFrame:
        """(sql_idx, iteration, ratio): gold time over predicted time, alternating.

        Pairs run one after the other, since concurrent jobs would disturb each
        other's times. A pair that fails, takes too long or does not match has
        the single ratio 0.
        """
        def ratios(row) -> list[float]:
            return [
                (1 / self._seconds(row.db_id, row.predicted_sql))
                * self._seconds(row.db_id, row.gold_sql)
                for _ in range(iterations)
            ]

        def timed() -> Iterator[tuple]:
            wanted = pairs.select("sql_idx", "db_id", "predicted_sql", "gold_sql")
            for row in wanted.toLocalIterator():
                match = self.matches(row.db_id, row.predicted_sql or " ", row.gold_sql)
                found = [0.0]
                if match.ok and match.value == 1:
                    run = self.guarded(
                        lambda r=row: ratios(r), timeout=self.timeout * iterations
                    )
                    found = run.value if run.ok else found
                yield from ((row.sql_idx, i, float(x)) for i, x in enumerate(found))

        return self._collect_outcomes(
            timed(), "sql_idx long, iteration int, ratio double", "timings"
        )


def evaluation_pairs(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Pair predictions with gold queries by ``sql_idx``; gold decides which exist."""
    return gold.select("sql_idx", "db_id", "gold_sql").join(
        predictions.select("sql_idx", F.col("predicted_sql")), "sql_idx", "left"
    )
