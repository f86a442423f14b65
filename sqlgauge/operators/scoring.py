"""Scores: result-set match, accuracy per difficulty and efficiency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.functions.difficulty import difficulty
from sqlgauge.functions.wordlists import DIFFICULTY_LEVELS

# --- result-set match ------------------------------------------------------

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_FLOATING = (T.FloatType, T.DoubleType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _common_type(left: T.DataType, right: T.DataType) -> str | None:
    """Type in which two result columns are compared; None if they never match."""
    if left == right and not isinstance(left, T.BooleanType):
        return left.simpleString()
    pair = (left, right)
    if all(isinstance(t, _INTEGRAL) for t in pair):
        return "bigint"
    numeric = (*_INTEGRAL, *_FLOATING, T.DecimalType)
    if all(isinstance(t, numeric) for t in pair):
        return "double"
    if all(isinstance(t, (*_TEMPORAL, T.StringType, T.VarcharType, T.CharType)) for t in pair):
        return "string"
    if isinstance(left, T.NullType):
        return right.simpleString()
    if isinstance(right, T.NullType):
        return left.simpleString()
    return None


def _positional(df: DataFrame, types: list[str], side: int) -> DataFrame:
    names = [f"c{i}" for i in range(len(types))]
    cast = [F.col(n).cast(t).alias(n) for n, t in zip(names, types)]
    return df.toDF(*names).select(*cast, F.lit(side).alias("side"))


def column_types(predicted: DataFrame, gold: DataFrame) -> list[str] | None:
    """Type in which each column of two results is compared; None if their rows are never equal."""
    if len(predicted.columns) != len(gold.columns):
        return None
    types = [
        _common_type(p.dataType, g.dataType)
        for p, g in zip(predicted.schema.fields, gold.schema.fields)
    ]
    return None if None in types else types


def result_match(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row ``res``: 1 if both queries return the same set of rows.

    Row order, repeats and column names do not matter, column positions do;
    NULL equals NULL. Repeats are dropped before the only shuffle, which is by
    the whole row, so a frequent row is no hot key. Two empty results are equal
    whatever their columns.
    """
    types = column_types(predicted, gold)
    if types is None:
        # Rows of unlike shape differ, so only two empty results are equal.
        some = [df.limit(1).select(F.lit(1).alias("one")) for df in (predicted, gold)]
        return some[0].unionByName(some[1]).agg(
            (F.count(F.lit(1)) == 0).cast("int").alias("res")
        )
    names = [f"c{i}" for i in range(len(types))]
    both = _positional(predicted, types, 1).unionByName(_positional(gold, types, 2))
    sides = both.groupBy(*names).agg(F.bit_or("side").alias("sides"))
    return sides.agg(F.coalesce(F.min((F.col("sides") == 3).cast("int")), F.lit(1)).alias("res"))


def match_table(pairs: list[tuple[int, DataFrame, DataFrame]]) -> DataFrame:
    """(sql_idx, res) of several pairs, as one lazy plan."""
    rows = [
        result_match(p, g).select(F.lit(i).cast("long").alias("sql_idx"), "res")
        for i, p, g in pairs
    ]
    return reduce(DataFrame.unionByName, rows)


# --- accuracy --------------------------------------------------------------


def with_difficulty(samples: DataFrame) -> DataFrame:
    """Fill a missing ``difficulty`` from the gold query."""
    gold = F.coalesce(F.col("gold_sql"), F.lit(""))
    given = F.col("difficulty") if "difficulty" in samples.columns else F.lit(None).cast("string")
    return samples.withColumn("difficulty", F.coalesce(given, difficulty(gold)))


def _by_level(scored: DataFrame, score: Column, name: str) -> DataFrame:
    """(level, count, <name>) for each level and ``total``; 0 for an empty one.

    One pass: conditional aggregates are combined in every task, so that only
    one row per task is shuffled.
    """
    levels = [*DIFFICULTY_LEVELS, "total"]
    inside = [F.col("difficulty") == level for level in DIFFICULTY_LEVELS] + [F.lit(True)]
    sums = scored.agg(
        *[F.count_if(i).alias(f"n{k}") for k, i in enumerate(inside)],
        *[F.sum(F.when(i, score)).alias(f"s{k}") for k, i in enumerate(inside)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(level).alias("level"),
                F.col(f"n{k}").alias("count"),
                F.coalesce(F.try_divide(F.col(f"s{k}"), F.col(f"n{k}")), F.lit(0.0)).alias(name),
            )
            for k, level in enumerate(levels)
        ]
    )
    return sums.select(F.inline(rows))


def accuracy_by_difficulty(results: DataFrame, samples: DataFrame) -> DataFrame:
    """(level, count, accuracy in percent) of (sql_idx, res) results."""
    levels = with_difficulty(samples).select("sql_idx", "difficulty")
    scored = results.join(levels, "sql_idx", "left")
    return _by_level(scored, F.col("res").cast("double") * 100, "accuracy")


# --- efficiency ------------------------------------------------------------


def clean_abnormal(timings: DataFrame, key: str = "sql_idx", value: str = "ratio") -> DataFrame:
    """Keep values within three population deviations of the mean of their key.

    A key whose values are all equal keeps them. Mean and deviation come from
    an aggregation that is joined back: no key is gathered in one task.
    """
    stats = timings.groupBy(key).agg(
        F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std")
    )
    near = F.abs(F.col(value) - F.col("_mean")) < 3 * F.col("_std")
    return (
        timings.join(stats, key)
        .where(near | (F.col("_std") == 0))
        .drop("_mean", "_std")
    )


def time_ratios(timings: DataFrame) -> DataFrame:
    """(sql_idx, time_ratio) of (sql_idx, ratio) iterations, without outliers."""
    return clean_abnormal(timings).groupBy("sql_idx").agg(F.avg("ratio").alias("time_ratio"))


def efficiency_score(ratios: DataFrame) -> DataFrame:
    """One row ``ves``: mean of ``sqrt(time_ratio) * 100``; 0 without samples."""
    score = F.avg(F.sqrt("time_ratio") * 100)
    return ratios.agg(F.coalesce(score, F.lit(0.0)).alias("ves"))


def efficiency_by_difficulty(ratios: DataFrame, samples: DataFrame) -> DataFrame:
    """(level, count, ves) per difficulty and in total."""
    levels = with_difficulty(samples).select("sql_idx", "difficulty")
    scored = ratios.join(levels, "sql_idx", "left")
    return _by_level(scored, F.sqrt("time_ratio") * 100, "ves")


def report(scores: DataFrame, name: str) -> str:
    """One line per level of a ``*_by_difficulty`` frame (four rows): level, samples, score."""
    rows = {r["level"]: r for r in scores.collect()}
    lines = [f"{'level':<12}{'samples':>10}{name:>12}"]
    for level in [*DIFFICULTY_LEVELS, "total"]:
        lines.append(f"{level:<12}{rows[level]['count']:>10}{rows[level][name]:>12.2f}")
    return "\n".join(lines)
