"""Many statements in one plan: a window of statements is united and run as one Spark job.

Planning a statement needs the driver, so the driver sees the texts of one window at a time, one text
of each shape and a few held failures, and nothing else: rows, comparisons and outcomes stay on the executors and are written to a table by
Spark. Windows are independent, and a few run at a time. Every distinct statement or pair of statements is run once.

A statement that cannot be analysed is a literal row. If the job of a window
fails or takes too long, the window is halved and each half runs again, down to the one statement that is
to blame; so a window without failures costs one job, and one with f failures about f log n.

A quarter of a window of statements, or more, that differ only in numbers are one job, if ``operators.shapes``
can share them. If it fails, so are its halves; what still fails in the end is run statement by
statement, on a copy of the table that is dealt into files by the column that the numbers are for.
"""

from __future__ import annotations

import functools
import threading
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.operators import shapes
from sqlgauge.operators.scoring import column_types
from sqlgauge.session import materialise, shared_folder

WINDOW = 32
_LEAST_OF_A_SHAPE = 4  # windows have so many times the statements that are worth a job of their own
_PLANNERS = 4  # for each statement that runs
_FLUSH_ROWS = 2000
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def comparable_row(df: DataFrame, types: list[str]) -> DataFrame:
    """Rows as arrays of texts, equal exactly if the rows are equal in the given column types."""
    names = [f"c{i}" for i in range(len(types))]
    named = df.toDF(*names).select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types)])
    cells = [_cell_text(F.col(f.name), f.dataType) for f in named.schema.fields]
    return named.select(F.array(*cells).cast("array<string>").alias("row"))


def _cell_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, _NESTED):
        return F.to_json(F.struct(c.alias("v")))
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0)).cast("string")  # one zero
    return c.cast("string")


def shared_match(asked: DataFrame, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(statement, res) as of :func:`match_window`, for ``asked`` statements with results (statement, c0, c1, ...)."""
    types = column_types(predicted.drop("statement"), gold.drop("statement"))
    sides = []
    for i, df in enumerate((predicted, gold)):
        side = F.lit(1 << i).alias("side")
        if types is None:
            row = df.select("statement").distinct().select("statement", side, F.array(F.lit(f"side {i}")).alias("row"))
        else:
            named = df.select("statement", *[F.col(f"c{k}").cast(t).alias(f"c{k}") for k, t in enumerate(types)])
            cells = [_cell_text(F.col(f.name), f.dataType) for f in named.schema.fields[1:]]
            row = named.select("statement", side, F.array(*cells).cast("array<string>").alias("row"))
        sides.append(row)
    return _met(asked, sides[0].unionAll(sides[1]))


def _met(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(statement, res): 1 if all rows (statement, side, row) of a statement are on both sides."""
    sides = rows.groupBy("statement", "row").agg(F.bit_or("side").alias("sides"))
    met = sides.groupBy("statement").agg(F.min((F.col("sides") == 3).cast("int")).alias("met"))
    return asked.join(met, "statement", "left").select("statement", F.coalesce("met", F.lit(1)).alias("res"))


def tagged_results(key: int, predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """(statement, side, row) of both results; rows of unlike shape never meet."""
    types = column_types(predicted, gold)
    if types is None:
        rows = [df.limit(1).select(F.array(F.lit(f"side {i}")).alias("row")) for i, df in enumerate((predicted, gold))]
    else:
        rows = [comparable_row(df, types) for df in (predicted, gold)]
    sides = [r.select(F.lit(key).cast("long").alias("statement"), F.lit(1 << i).alias("side"), "row") for i, r in enumerate(rows)]
    return sides[0].unionAll(sides[1])


def match_window(window: list[tuple[int, DataFrame, DataFrame]]) -> DataFrame:
    """(statement, res) of the pairs of a window: 1 if both return the same set of rows.

    One aggregation for all pairs, by statement and row; repeats vanish before the shuffle. Two
    empty results leave no row behind and are equal.
    """
    spark = window[0][1].sparkSession
    rows = functools.reduce(DataFrame.unionAll, [tagged_results(*w) for w in window])
    keys = F.array(*[F.lit(k).cast("long") for k, _, _ in window])
    return _met(spark.range(0, 1, 1, 1).select(F.explode(keys).alias("statement")), rows)


def _quoted(text: Column) -> Column:
    has = lambda q: F.contains(text, F.lit(q))
    plain = F.concat(F.lit("'"), text, F.lit("'"))
    double = F.concat(F.lit('"'), text, F.lit('"'))
    escaped = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(~has("'"), plain).when(~has('"'), double).otherwise(escaped)


def _shown_cell(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BooleanType):
        shown = F.when(c, F.lit("True")).otherwise(F.lit("False"))
    elif isinstance(kind, (T.NumericType, T.NullType)):
        shown = c.cast("string")
    else:
        shown = _quoted(_cell_text(c, kind))
    return F.when(c.isNull(), F.lit("None")).otherwise(shown)


def shown_result(df: DataFrame, rows: int | None) -> DataFrame:
    """(message): the first ``rows`` rows of a result as a list of tuples, in one row; None for all."""
    names = [f"c{i}" for i in range(len(df.columns))]
    named = df.toDF(*names)
    named = named if rows is None else named.limit(rows)
    numbered = named.select(F.monotonically_increasing_id().alias("at"), _line(named.schema.fields).alias("line"))
    return numbered.agg(_listed(_lines()).alias("message"))


def shared_result(asked: DataFrame, df: DataFrame, order: list[Column], rows: int | None) -> DataFrame:
    """(statement, message) as of :func:`shown_result`, for ``asked`` statements with results (statement, c0, ...)."""
    at = F.row_number().over(W.partitionBy("statement").orderBy(*order)).alias("at")
    numbered = df.select("*", at)
    numbered = numbered if rows is None else numbered.where(F.col("at") <= rows)
    lines = numbered.select("statement", "at", _line(df.schema.fields[1:]).alias("line")).groupBy("statement").agg(_lines().alias("lines"))
    none = F.array().cast("array<string>")
    return asked.join(lines, "statement", "left").select("statement", _listed(F.coalesce("lines", none)).alias("message"))


def _lines() -> Column:
    return F.sort_array(F.collect_list(F.struct("at", "line")))["line"]


def _listed(lines: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]"))


def _line(fields: list[T.StructField]) -> Column:
    cells = [_shown_cell(F.col(f.name), f.dataType) for f in fields]
    return F.concat(F.lit("("), F.concat_ws(", ", *cells), F.lit(",)" if len(cells) == 1 else ")"))


def _part(n: Column) -> Column:
    return F.pmod(F.xxhash64("statement"), n).cast("int")


def _failed_parts(runs, n: int, window: int) -> list[tuple[int, int]]:
    """The (parts, part) of ``n`` statements that fail, down to about a window each.

    Parts that fail are halved, all of a size before any smaller one. Where a quarter is not to be
    had without a failure, failures are everywhere, and halving on would run everything many times.
    """
    level, parts = [(1, 0)], 1
    while True:
        bad = [p for p in level if not runs(*p)]
        if not bad or n // parts <= window or (parts >= 4 and len(bad) == parts):
            return bad
        level = [(2 * parts, i) for _, part in bad for i in (part, part + parts)]
        parts *= 2


class Batches:
    """Runs windows of statements through an executor's sessions and stores their outcomes."""

    def __init__(self, executor, schema: str, name: str, window: int = WINDOW):
        self.executor, self.schema, self.window = executor, schema, window
        self.path = f"{shared_folder(executor.spark)}/{name}-{uuid.uuid4().hex}"
        self.held: list[tuple] = []
        self.lock = threading.Lock()

    def run(self, statements: DataFrame, texts: list[str], plan, united, failure, shared, alike: bool = False) -> DataFrame:
        """Outcomes (statement, ...) of ``statements`` (statement, db_id, ``texts``).

        ``plan(row, by)`` makes what one statement needs, ``united(window)`` the outcome rows of
        (statement, plan) pairs, ``failure(statement, condition, error)`` the outcome of a failure, and
        ``shared(group, asked, frames)`` the rows of a shape: one of its statements is in ``group``; None
        if outcomes of the ``asked`` ones cannot be told from their results. With ``alike``, failures
        of the same condition have the same outcome: a shape without a plan is not planned one by one.
        """
        spark = self.executor.spark
        columns = ["statement", "db_id", *texts]
        slots = [shapes.shape_of(texts).alias("shape"), shapes.slots_of(texts).alias("slots")]
        kept = materialise(statements.select(*columns, *slots), "statements")
        spark.createDataFrame([], self.schema).write.parquet(f"{self.path}/none")  # if nothing is run
        no_plan = (lambda row: self._planned([row], lambda r: plan(r, ()), map)[1]) if alike else (lambda row: [])
        run_as_shape, lookups = self._shapes(kept, texts, shared, lambda row: [failure(*b) for b in no_plan(row)])
        # one row per shape of a window or more, one per part of it that failed
        done = spark.createDataFrame(run_as_shape, "db_id string, shape string")
        parts = spark.createDataFrame([p[:-1] for p in lookups], "db_id string, shape string, n int, part int, lookup int")
        rest = kept.join(F.broadcast(done), ["db_id", "shape"], "left_anti").withColumn("lookup", F.lit(None).cast("int"))
        here = _part(F.col("n")) == F.col("part")
        alone = kept.join(F.broadcast(parts), ["db_id", "shape"]).where(here).select(*rest.columns)
        rest = rest.unionAll(alone) if lookups else rest
        n = rest.count()
        spread = F.pmod(F.xxhash64("statement"), F.lit(max(1, -(-n // self.window)))).alias("bucket")
        keys = ["db_id", "lookup", "bucket"]
        rest = materialise(rest.select(*columns, "lookup", spread), "windows", partition_by=keys)
        windows = rest.select(*keys).distinct().collect()  # one row per window

        def one(w) -> None:
            mine = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.lit(w[k])) for k in keys])
            rows = sorted(rest.where(mine).collect(), key=lambda r: r["statement"])
            by = None if w["lookup"] is None else lookups[w["lookup"]][-1]
            ready, broken = self._planned(rows, lambda row: plan(row, by or ()), planners.map)
            self._hold([failure(*b) for b in broken])
            # a shape that fails everywhere: its statements are run one by one, on copies of their tables
            for some in [ready] if by is None else [[r] for r in ready]:
                if some:
                    self._halves(some, united, lambda _, *f: self._hold([failure(*f)]))

        threads = self.executor.parallelism
        with ThreadPoolExecutor(threads) as pool, ThreadPoolExecutor(threads * _PLANNERS) as planners:
            for _ in pool.map(one, windows):
                pass
        self._hold([], flush=True)
        return spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)

    def _shapes(self, kept: DataFrame, texts: list[str], shared, no_plan) -> tuple[list[tuple], list[tuple]]:
        """Runs the shapes that can be shared: (db_id, shape) of them, and their parts that failed.

        A part is (db_id, shape, n, part, number, by): those statements of the shape that :func:`_part` of n puts there.
        """
        one = F.min_by(F.struct("statement", "db_id", *texts), "statement").alias("one")
        counted = kept.where("shape IS NOT NULL AND db_id IS NOT NULL").groupBy("db_id", "shape")
        found = counted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("slots")).alias("n_slots"), one)
        found = found.where(F.col("n") >= max(2, self.window // _LEAST_OF_A_SHAPE)).collect()
        with ThreadPoolExecutor(max_workers=self.executor.parallelism) as pool:
            tried = list(pool.map(lambda g: self._shape(kept, g, texts, shared, no_plan), found))
        done = [(g["db_id"], g["shape"]) for g, bad in zip(found, tried) if bad is not None]
        parts = []
        for g, bad in zip(found, tried):
            if bad:
                tables = {t: v.columns for t, v in self.executor.tables(g["db_id"]).items()}
                by = shapes.looked_up(tables, [g["one"][t] for t in texts])
                parts += [(g["db_id"], g["shape"], n, part, len(parts) + i, by) for i, (n, part) in enumerate(bad)]
        return done, parts

    def _shape(self, kept: DataFrame, group, texts: list[str], shared, no_plan) -> list[tuple[int, int]] | None:
        """The parts (n, part) of a shape that failed; None if it cannot be shared."""
        view = f"asked_{uuid.uuid4().hex}"
        numbers = [F.get("slots", F.lit(i)).alias(f"slot_{i}") for i in range(group["n_slots"])]
        own = kept.where((F.col("db_id") == group["db_id"]) & (F.col("shape") == group["shape"]))
        own = own.select("statement", *numbers)

        def outcomes(n: int, part: int) -> DataFrame | None:
            own.where(_part(F.lit(n)) == part).createOrReplaceGlobalTempView(view)
            frames = shapes.shared_frames(self.executor, group["db_id"], [group["one"][t] for t in texts], view)
            asked = frames and frames[0].sparkSession.table(f"global_temp.{view}").select("statement")
            return frames and shared(group, asked, frames)

        def runs(n: int, part: int) -> bool:
            limit = self.executor.timeout * max(1, group["n"] // n // self.executor.parallelism)
            return self.executor.guarded(lambda: self._write(outcomes(n, part) if n > 1 else every), timeout=limit).ok

        try:
            every = outcomes(1, 0)
            if every is None:
                return None
        except (PySparkException, ValueError, KeyError):
            for outcome in no_plan(group["one"]):
                names = T._parse_datatype_string(self.schema).names[1:]
                self._write(own.select("statement", *[F.lit(v).alias(c) for c, v in zip(names, outcome[1:])]))
                return []
            return None
        try:
            return _failed_parts(runs, group["n"], self.window)
        finally:
            self.executor.spark.catalog.dropGlobalTempView(view)

    @staticmethod
    def _planned(rows: list, plan, mapped) -> tuple[list[tuple], list[tuple]]:
        """(statement, plan) of the rows, and (statement, condition, error) of those without a plan.

        An error takes long to come from the JVM, mostly by waiting; so there are many planners.
        """
        ready, broken = [], []

        def one(row) -> None:
            try:
                ready.append((row["statement"], *plan(row)))
            except PySparkException as error:
                broken.append((row["statement"], error.getCondition(), str(error)))
            except (ValueError, KeyError) as error:
                broken.append((row["statement"], type(error).__name__, str(error)))

        for _ in mapped(one, rows):
            pass
        return sorted(ready, key=lambda r: r[0]), broken

    def _hold(self, outcomes: list[tuple], flush: bool = False) -> None:
        """Keeps outcomes of failures until they are worth a file."""
        with self.lock:
            self.held += outcomes
            full = flush and self.held or self.held[: len(self.held) // _FLUSH_ROWS * _FLUSH_ROWS]
            self.held = self.held[len(full) :]
        if full:
            self._write(self.executor.spark.createDataFrame(full, self.schema).coalesce(1))

    def _write(self, outcomes: DataFrame | None) -> None:
        """Outcomes in a folder of their own: complete, or not there at all. None if they are held."""
        if outcomes is None:
            return
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(self.schema).fields]
        outcomes.select(*typed).write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def _halves(self, window: list[tuple], united, failed, bad: bool = False) -> bool:
        """Did all statements run? With ``bad`` one is known to fail: the whole is not tried again."""
        slow = False
        if not bad or len(window) == 1:
            limit = self.executor.timeout * max(1, len(window) // self.executor.parallelism)
            outcome = self.executor.guarded(lambda: self._write(united(window)), timeout=limit)
            if outcome.ok:
                return True
            if len(window) == 1:
                self._write(failed(self.executor.spark, window[0][0], outcome.condition, outcome.error))
                return False
            slow = outcome.condition == "TIMEOUT"  # halves of a slow window may both be in time
        half = len(window) // 2
        first = self._halves(window[:half], united, failed)
        self._halves(window[half:], united, failed, bad=first and not slow)
        return False


def evaluate(executor, pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(sql_idx, res, condition) of pairs (sql_idx, db_id, predicted_sql, gold_sql).

    A missing prediction, an error and a time-out count as 0 and have a condition.
    """
    filled = pairs.select("sql_idx", "db_id", F.coalesce("predicted_sql", F.lit(" ")).alias("predicted_sql"), "gold_sql")
    key = F.xxhash64("db_id", "predicted_sql", "gold_sql").alias("statement")
    keyed = materialise(filled.select("sql_idx", key, "db_id", "predicted_sql", "gold_sql"), "pairs")
    distinct = keyed.drop("sql_idx").dropDuplicates(["statement"])

    def plan(row, by) -> tuple[DataFrame, DataFrame]:
        return tuple(executor.query(row["db_id"], row[t], by) for t in ("predicted_sql", "gold_sql"))

    def united(part: list) -> DataFrame:
        return match_window(part).withColumn("condition", F.lit(None).cast("string"))

    def shared(group, asked: DataFrame, frames: list[DataFrame]) -> DataFrame:
        return shared_match(asked, *frames).withColumn("condition", F.lit(None).cast("string"))

    def failure(statement: int, condition: str, error: str) -> tuple:
        return statement, 0, condition

    batches = Batches(executor, "statement long, res int, condition string", "results", window)
    found = batches.run(distinct, ["predicted_sql", "gold_sql"], plan, united, failure, shared, alike=True)
    return keyed.select("sql_idx", "statement").join(found, "statement").drop("statement")


def check_all(executor, drafts: DataFrame, rows: int | None = None, window: int = WINDOW) -> DataFrame:
    """(sql_idx, ok, message, condition) of drafts (sql_idx, db_id, predicted_sql).

    ``message`` is the error, or the result as text: its first ``rows`` rows, or all.
    """
    key = F.xxhash64("db_id", "predicted_sql").alias("statement")
    keyed = materialise(drafts.select("sql_idx", key, "db_id", "predicted_sql"), "drafts")

    def plan(row, by) -> tuple[DataFrame]:
        return (executor.query(row["db_id"], row["predicted_sql"], by),)

    def united(part: list) -> DataFrame:
        none = F.lit(None).cast("string").alias("condition")
        shown = [
            shown_result(df, rows).select(F.lit(k).cast("long").alias("statement"), F.lit(True).alias("ok"), "message", none)
            for k, df in part
        ]
        return functools.reduce(DataFrame.unionAll, shown)

    def shared(group, asked: DataFrame, frames: list[DataFrame]) -> DataFrame | None:
        order = shapes.order_of(executor, group["db_id"], group["one"]["predicted_sql"])
        if order is None:
            return None  # which rows are the first ones is the business of the statement's own plan
        shown = shared_result(asked, frames[0], order, rows)
        return shown.select("statement", F.lit(True).alias("ok"), "message", F.lit(None).cast("string").alias("condition"))

    def failure(statement: int, condition: str, error: str) -> tuple:
        return statement, False, error, condition

    batches = Batches(executor, "statement long, ok boolean, message string, condition string", "outcomes", window)
    found = batches.run(keyed.drop("sql_idx").dropDuplicates(["statement"]), ["predicted_sql"], plan, united, failure, shared)
    return keyed.select("sql_idx", "statement").join(found, "statement").drop("statement")
