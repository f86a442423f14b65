"""Stored values of a database and their retrieval for a question.

The distinct values of all columns form one long frame. Stored, each value has
its ``place`` in the order of its column: a small number that stands for the
text in every join, breaks ties in value order, and marks the first values.
BM25 is in ``operators.bm25``; the fuzzy match runs on the pairs that an index of
grams and rare words finds.

How the work is spread: all steps are equi-joins. The smaller side is broadcast only
if its measured size is small; beyond, the rows of a key are split over several
tasks (``operators.joins``). Ranking keeps at most k rows per question and column in
each task before anything is shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.functions.similarity import (
    MATCH_NAMES,
    Matcher,
    comparable,
    fuzzy_match,
    grams_of,
    matches_of,
    may_match,
    run_grams,
    shortest_run_column,
    span_words,
    start_grams,
    word_starts,
)
from sqlgauge.functions.text import let, strip
from sqlgauge.functions.wordlists import MATCH_THRESHOLD, VALUES_KEPT
from sqlgauge.operators import bm25
from sqlgauge.operators.bm25 import COLUMN_KEY, PAIR_KEY, VALUE_KEY
from sqlgauge.operators.joins import if_small, spread_join
from sqlgauge.session import drop_shuffles, materialise, task_count

_STRETCH = 1024
INDEX_ROWS = 500_000  # grams and words of values that a task can hold as a dictionary
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def column_values(
    databases: dict[str, dict[str, DataFrame]],
    columns: set[tuple[str, str]] | None = None,
) -> DataFrame:
    """Distinct non-empty values of every (or the chosen) column, as text.

    One scan per table: its columns are stacked into rows and made distinct in
    a single aggregation, which drops repeats before the shuffle. Columns go by
    number until then, and get their names afterwards.
    """
    numbers: dict[tuple[str, str, str], int] = {}
    text_columns: set[int] = set()
    stacked = []
    for db_id, tables in databases.items():
        for name, df in tables.items():
            cells = []
            for f in df.schema.fields:
                if isinstance(f.dataType, _NESTED) or not (
                    columns is None or (name, f.name) in columns
                ):
                    continue
                number = numbers.setdefault((db_id, name.lower(), f.name.lower()), len(numbers))
                if isinstance(f.dataType, T.StringType):
                    text_columns.add(number)
                cells.append(
                    F.struct(
                        F.lit(number).alias("number"), F.col(f.name).cast("string").alias("value")
                    )
                )
            if cells:
                stacked.append(df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*"))
    rows = stacked[0]
    for more in stacked[1:]:
        rows = rows.unionByName(more)
    present = F.col("value").isNotNull() & (F.col("value") != "")
    # One row per column of the databases, made from their schemas.
    names = rows.sparkSession.createDataFrame(
        [(n, *key, n in text_columns) for key, n in numbers.items()],
        "number int, db_id string, table_name string, column_name string, is_text boolean",
    )
    distinct = rows.where(present).groupBy("number", "value").agg(F.lit(1).alias("one"))
    return distinct.join(F.broadcast(names), "number").select(*COLUMN_KEY, "value", "is_text")


def first_values(
    databases: dict[str, dict[str, DataFrame]],
    k: int,
    columns: set[tuple[str, str]] | None = None,
) -> DataFrame:
    """(column, place, value): the ``k`` smallest distinct non-empty values of each column, as text.

    One scan for any ``k``: a task keeps the ``k`` least texts it has met of each column, and only
    these leave it, so nothing is made distinct or sorted beyond ``k`` rows per task and column.
    """
    names: list[tuple[int, str, str, str]] = []
    parts = []
    session = next(iter(next(iter(databases.values())).values())).sparkSession
    for db_id, tables in databases.items():
        for table, df in tables.items():
            own = [
                f.name
                for f in df.schema.fields
                if not isinstance(f.dataType, _NESTED) and (columns is None or (table, f.name) in columns)
            ]
            if own and k > 0:
                texts = df.select(*[F.col(f"`{f}`").cast("string").alias(f"c{i}") for i, f in enumerate(own)])
                parts.append(texts.mapInArrow(_least_texts(k, len(names)), "number int, value string"))
                names += [(len(names) + i, db_id, table.lower(), f.lower()) for i, f in enumerate(own)]
    # one row per column of the databases, made from their schemas
    columns_of = session.createDataFrame(names, "number int, db_id string, table_name string, column_name string")
    least = functools.reduce(DataFrame.unionAll, parts) if parts else columns_of.select("number", F.lit("").alias("value"))
    place = F.row_number().over(W.partitionBy("number").orderBy("value")).cast("long").alias("place")
    ranked = least.distinct().select("number", place, "value").where(F.col("place") <= k)
    return ranked.join(F.broadcast(columns_of), "number").select(*COLUMN_KEY, "place", "value")


def _least_texts(k: int, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task (number, value): the ``k`` least texts of each column, numbered from ``first``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, pa.Array] = {}
        for batch in batches:
            for i, texts in enumerate(batch.columns):
                held = found.get(i)
                if held is not None and len(held) == k:
                    texts = texts.filter(pc.less(texts, held[-1]))
                texts = texts.filter(pc.not_equal(texts, "")).unique()
                if len(texts):
                    both = texts if held is None else pa.concat_arrays([held, texts]).unique()
                    found[i] = both.take(pc.array_sort_indices(both)[:k])
        for i, held in found.items():
            number = pa.array([first + i] * len(held), pa.int32())
            yield pa.RecordBatch.from_arrays([number, held], ["number", "value"])

    return run


def picklists(
    databases: dict[str, dict[str, DataFrame]],
    k: int = 3,
    columns: set[tuple[str, str]] | None = None,
) -> DataFrame:
    """First ``k`` values of each column as one array."""
    return (
        first_values(databases, k, columns)
        .groupBy(*COLUMN_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
        .select(*COLUMN_KEY, F.col("v.value").alias("first_values"))
    )


def store_values(values: DataFrame) -> DataFrame:
    """Write the values to the shared folder, numbered in value order per column.

    A range-partitioned sort spreads long columns over tasks. Row ids then grow
    in sorted order, and a column's place is its id less the first id of its
    stretch, plus the lengths of its earlier stretches (one row per task and
    column).
    """
    order = [*COLUMN_KEY, "value"]
    ordered = values.repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_rows = materialise(
        ordered.select(
            *order,
            "is_text",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "sorted-values",
    )
    drop_shuffles(values.sparkSession)  # texts moved twice, to be distinct and to be in order
    before = W.partitionBy(*COLUMN_KEY).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    stretches = (
        sorted_rows.groupBy(*COLUMN_KEY, "part")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    place = F.col("id") - F.col("first_id") + 1 + F.col("before")
    # One row per task and column: the number of tasks bounds the broadcast.
    return sorted_rows.join(F.broadcast(stretches), [*COLUMN_KEY, "part"]).select(
        *COLUMN_KEY, place.alias("place"), "value", "is_text"
    )


# --- BM25 ------------------------------------------------------------------


def bm25_scores(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """(sql_idx, column, place, score) of every value sharing a word with a question.

    All other values score 0. ``questions`` is (sql_idx, db_id, question),
    ``stored`` comes from :func:`store_values`.
    """
    return bm25.score_all(bm25.build_index(questions, stored))


def bm25_texts(questions: DataFrame, stored: DataFrame) -> DataFrame:
    """:func:`bm25_scores` with the ``value``; only texts that hold a word of a question go to meet the scores."""
    index = bm25.build_index(questions, stored)
    return spread_join(bm25.score_all(index), bm25.texts_met(index, stored), VALUE_KEY, "sql_idx")


def bm25_topk(questions: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best scored values per question and column; ties in value order."""
    top = materialise(bm25.top_values(bm25.build_index(questions, stored), k), "top-values")
    # broadcast where that is possible, so that texts do not move to meet the few rows that name them
    return if_small(top)


def with_text(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Add the ``value`` of (column, place)."""
    return rows.join(stored.select(*VALUE_KEY, "value"), VALUE_KEY)


# --- fuzzy match -----------------------------------------------------------


def _theta_of(theta: float, names_exact: bool) -> Column:
    """Least score of a stored value: 1 where a lower one never counts."""
    plain_upper = F.col("value").rlike(r"^[\x00-\x7F]*$") & F.col("value").rlike("[A-Z]") & ~F.col("value").rlike("[a-z]")
    exact = plain_upper | F.col("column_name").contains("name") if names_exact else plain_upper
    return F.when(exact, F.lit(1.0)).otherwise(F.lit(theta))


def _fuzzy_index(values: DataFrame, theta: float, key: list[str] = VALUE_KEY) -> DataFrame:
    """(``key``, gram), the key of a value being (column, place): grams that a question has at a word start if it matches the value.

    A value of n characters shares a run of at least ``shortest_run(n)`` with a matching question,
    so one of its places leaves room for the run; the first characters of the run are the gram.
    """
    run = shortest_run_column(F.char_length("stored"), theta)
    rows = values.select(*key, "stored", run.alias("run")).where("run > 0")
    return rows.select(
        *key,
        F.explode(run_grams(F.col("stored"), F.col("run"))).alias("gram"),
    )


def _exact_index(values: DataFrame, key: list[str] = VALUE_KEY) -> DataFrame:
    """(``key``, gram): each value under its rarest word.

    A score of 1 needs the whole value in the question, its rarest word included.
    """
    word = F.explode(F.array_distinct(span_words(F.col("stored")))).alias("gram")
    words = values.select(*key, word)
    counts = words.groupBy("db_id", "gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.min_by("gram", F.struct("df", "gram")).alias("gram")
    return words.join(counts, ["db_id", "gram"]).groupBy(*key).agg(rarest)


def fuzzy_candidates(
    questions: DataFrame,
    values: DataFrame,
    theta: float = MATCH_THRESHOLD,
    names_exact: bool = False,
) -> DataFrame:
    """(sql_idx, column, place) of pairs that may match, by an equi-join on grams or words.

    ``questions`` has (sql_idx, db_id, asked), ``values`` (column, place, value, stored), both
    texts in the form of :func:`comparable`. No matching pair is left out.
    """
    least = materialise(values.withColumn("least", _theta_of(theta, names_exact)), "compared")
    loose = materialise(_fuzzy_index(least.where("least < 1"), theta), "grams")
    strict = materialise(_exact_index(least.where("least >= 1")), "rarest-words")
    # at most one row per rung of the ladder of gram lengths
    lengths = sorted(r[0] for r in loose.select(F.char_length("gram").alias("n")).distinct().collect())
    found = []
    if lengths:
        grams = F.explode(F.array_distinct(start_grams(F.col("asked"), lengths)))
        asked = questions.select("sql_idx", "db_id", grams.alias("gram"))
        found.append(spread_join(asked, loose, ["db_id", "gram"], "sql_idx"))
    words = F.explode(F.array_distinct(span_words(F.col("asked")))).alias("gram")
    asked = questions.select("sql_idx", "db_id", words)
    found.append(spread_join(asked, strict, ["db_id", "gram"], "sql_idx"))
    pairs = found[0].select(*PAIR_KEY, "place")
    for more in found[1:]:
        pairs = pairs.unionByName(more.select(*PAIR_KEY, "place"))
    return pairs.distinct()


def fuzzy_pairs(
    questions: DataFrame,
    stored: DataFrame,
    theta: float = MATCH_THRESHOLD,
    names_exact: bool = False,
) -> DataFrame:
    """Fuzzy matches between questions and the stored text values of their database.

    With ``names_exact`` only perfect matches are looked for in columns called ``*name*``.
    """
    texts = materialise(
        stored.where("is_text").select(*VALUE_KEY, "value", comparable(F.col("value")).alias("stored")),
        "texts",
    )
    n = task_count(questions.sparkSession)
    asked = questions.repartition(n, "sql_idx").select(
        "sql_idx", "db_id", "question", comparable(F.col("question")).alias("asked")
    )
    asked = materialise(asked.where("sql_idx IS NOT NULL AND question IS NOT NULL"), "compared-questions")
    matcher, numbered = _matcher(asked, texts, theta, names_exact)
    if matcher is not None:
        return _matches(asked, matcher, numbered)
    started = materialise(asked.withColumn("starts", word_starts(F.col("question"))), "word-starts")
    pairs = fuzzy_candidates(started, texts, theta, names_exact)
    full = spread_join(pairs, texts, VALUE_KEY, "sql_idx").join(started.drop("db_id"), "sql_idx")
    likely = full.where(may_match(F.col("asked"), F.col("starts"), F.col("stored"), theta))
    return _keep_matches(likely, theta)


def _matcher(
    asked: DataFrame, texts: DataFrame, theta: float, names_exact: bool
) -> tuple[Broadcast | None, DataFrame]:
    """The index of grams and rarest words, sent to all tasks; None if it is too large for that.

    And the values with their ``number`` in it. A large index loses the grams that no question has first.
    """
    spark = texts.sparkSession
    number = F.monotonically_increasing_id().alias("number")
    numbered = materialise(texts.select("*", _theta_of(theta, names_exact).alias("least"), number), "numbered")
    key = ["number", "db_id"]
    parts = [
        materialise(_fuzzy_index(numbered.where("least < 1"), theta, key), "grams"),
        materialise(_exact_index(numbered.where("least >= 1"), key), "rarest-words"),
    ]
    if sum(p.count() for p in parts) > INDEX_ROWS:
        # at most one row per rung of the ladder of gram lengths
        lengths = [r[0] for r in parts[0].select(F.char_length("gram")).distinct().collect()]
        met = asked.select("db_id", "asked").mapInArrow(_distinct_grams(sorted(lengths)), "db_id string, gram string")
        met = if_small(materialise(met.distinct(), "asked-grams"))
        parts = [materialise(p.join(met, ["db_id", "gram"], "left_semi"), "grams-met") for p in parts]
        if sum(p.count() for p in parts) > INDEX_ROWS:
            return None, numbered
    index: list[dict] = [{}, {}]
    for found, part in zip(index, parts):
        columns = part.select("db_id", "gram", "number").toArrow().to_pydict()
        for db_id, gram, n in zip(*columns.values()):
            found.setdefault(db_id, {}).setdefault(gram, []).append(n)
    met = parts[0].select("number").unionAll(parts[1].select("number")).distinct()
    values = numbered.join(met, "number", "left_semi").select("number", "value").toArrow().to_pydict()
    return spark.sparkContext.broadcast(Matcher(dict(zip(*values.values())), *index, theta)), numbered


def _distinct_grams(lengths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per batch (db_id, gram): the grams and words of its questions (db_id, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(d, g) for d, text in zip(*batch.to_pydict().values()) if text is not None for g in grams_of(text, lengths)}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*found)], ["db_id", "gram"])

    return run


def _matches(asked: DataFrame, matcher: Broadcast, numbered: DataFrame) -> DataFrame:
    """(sql_idx, column, place, value, match): a question is compared where it lies, with all its candidates at once."""
    found = asked.select("sql_idx", F.explode(matches_of(matcher, F.col("db_id"), F.col("question"), F.col("asked"))).alias("m"))
    values = if_small(numbered.select("number", *VALUE_KEY, "value"))
    return found.select("sql_idx", "m.*").join(values, "number").select(*PAIR_KEY, "place", "value", *MATCH_NAMES)


def _keep_matches(pairs: DataFrame, theta: float) -> DataFrame:
    kept = [*PAIR_KEY, "place", "value"]
    # Pairs of one question or value may be many: they are spread by both before
    # the Python step, which is the costly one.
    n = task_count(pairs.sparkSession)
    return (
        pairs.select(*kept, "question")
        .repartition(n, "sql_idx", "place")
        .withColumn("m", fuzzy_match(F.col("question"), F.col("value"), theta))
        .where(F.col("m.match_text").isNotNull())
        .select(*kept, "m.*")
    )


# --- value linking ---------------------------------------------------------


def link_values(
    questions: DataFrame,
    stored: DataFrame,
    k: int | None = None,
    keep: int = VALUES_KEPT,
    theta: float = MATCH_THRESHOLD,
) -> DataFrame:
    """(sql_idx, column, matches): up to ``keep`` values per question and column.

    Fuzzy matches come first, best score first; the best values by BM25 fill the remaining places.
    Numeric columns are only filled. With ``k``, only values among the ``k`` best by BM25 count as
    fuzzy matches; by default all do. Every column of the database has a row for every question.
    """
    questions = materialise(questions.select("sql_idx", "db_id", "question"), "questions")
    index = bm25.build_index(questions, stored)
    matches = materialise(fuzzy_pairs(questions, stored, theta, names_exact=True), "matches")
    scores = bm25.score_pairs(index, matches.select(*PAIR_KEY, "place").distinct())
    matches = matches.join(scores, [*PAIR_KEY, "place"], "left").na.fill(0.0, ["score"])
    if k is not None:
        matches = _among_first(matches, index, k)
    best = _best_matches(matches, keep)
    fill = _shared_fill(stored, index, 2 * keep)
    none = F.array().cast("array<string>")
    chosen = F.coalesce(F.col("chosen"), none)
    own = fill.join(best, PAIR_KEY, "full").select(*PAIR_KEY, chosen.alias("chosen"), "fill")
    return _every_column(questions, own, _first_texts(stored, 2 * keep), keep)


def _every_column(questions: DataFrame, own: DataFrame, first: DataFrame, keep: int) -> DataFrame:
    """Rows for all columns: what a question has of its own, else the first values of the column.

    Rows of its own are a map per question with one entry per column at most. The first values, one row
    per column, are broadcast, so questions do not move for the columns that they do not touch.
    """
    name = F.concat_ws(".", "table_name", "column_name")
    grouped = own.groupBy("sql_idx").agg(
        F.map_from_entries(F.collect_list(F.struct(name, F.struct("chosen", "fill")))).alias("own")
    )
    none = F.array().cast("array<string>")
    rows = questions.select("sql_idx", "db_id").join(grouped, "sql_idx", "left").join(F.broadcast(first), "db_id")
    rows = rows.withColumn("mine", F.try_element_at("own", name))
    chosen, fill = F.coalesce("mine.chosen", none), F.coalesce("mine.fill", "first")
    rest = let(chosen, lambda c: F.concat(c, F.filter(fill, lambda v: ~F.array_contains(c, v))))
    return rows.select(*PAIR_KEY, F.array_distinct(F.slice(rest, 1, keep)).alias("matches"))


def _first_texts(stored: DataFrame, size: int) -> DataFrame:
    """(column, first): the first ``size`` values of each column, in value order."""
    firsts = stored.where(F.col("place") <= size).groupBy(*COLUMN_KEY)
    return firsts.agg(F.sort_array(F.collect_list(F.struct("place", "value")))["value"].alias("first"))


def _among_first(matches: DataFrame, index: bm25.Index, k: int) -> DataFrame:
    """The matches whose value is among the ``k`` best of its column by (score descending, place).

    Values better than a match are counted: scored ones one by one, those without a score by
    their number. Only questions and columns that have a match are looked at.
    """
    asked = matches.select(*PAIR_KEY).distinct()
    scored = bm25.score_all(index, index.weights.join(asked, PAIR_KEY, "left_semi")).where("score <> 0")
    other = scored.select(*PAIR_KEY, F.col("place").alias("p"), F.col("score").alias("s"))
    better = (F.col("s") > F.col("score")) | ((F.col("s") == F.col("score")) & (F.col("p") < F.col("place")))
    counted = (
        matches.select(*PAIR_KEY, "place", "score")
        .distinct()
        .join(other, PAIR_KEY, "left")
        .groupBy(*PAIR_KEY, "place", "score")
        .agg(
            F.count_if(better).alias("n_better"),
            F.count("p").alias("n_scored"),
            F.count_if(F.col("p") < F.col("place")).alias("n_before"),
        )
        .join(F.broadcast(index.stats), COLUMN_KEY)
    )
    unscored = (
        F.when(F.col("score") > 0, 0)
        .when(F.col("score") == 0, F.col("place") - 1 - F.col("n_before"))
        .otherwise(F.col("n_values") - F.col("n_scored"))
    )
    kept = counted.where(F.col("n_better") + unscored < k).select(*PAIR_KEY, "place")
    return matches.join(kept, [*PAIR_KEY, "place"], "left_semi")


def _best_matches(matches: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best fuzzy matches per question and column, as an array.

    Of several values with the same matched text the last candidate counts, at
    the place of the first. Columns called ``*name*`` need a perfect score.
    """
    order = F.struct((-F.col("score")).alias("s"), "place")
    one_per_text = (
        matches.withColumn("ord", order)
        .groupBy(*PAIR_KEY, "match_text")
        .agg(
            F.min("ord").alias("first"),
            F.max_by(F.struct("value", "match_score", "match_size"), "ord").alias("m"),
        )
    )
    score = F.col("m.match_score")
    weight = 1e16 * score + 1e8 * score + F.col("m.match_size")
    usable = (F.col("table_name") != "sqlite_sequence") & (
        ~F.col("column_name").contains("name") | (score >= 1)
    )
    best = W.partitionBy(*PAIR_KEY).orderBy(weight.desc(), F.col("first"))
    top = one_per_text.where(usable).withColumn("n", F.row_number().over(best))
    return (
        top.where(F.col("n") <= keep)
        .groupBy(*PAIR_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("n", strip(F.col("m.value")).alias("v")))).alias("c"))
        .select(*PAIR_KEY, F.col("c.v").alias("chosen"))
    )


def _free_places(size: int) -> Column:
    """The first ``size`` places of a column that are not in ``high``, which has fewer than that."""
    reach = F.least(F.col("n_values"), F.lit(size) + F.size("high"))
    return F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), reach), "high"), 1, size)


def _shared_fill(stored: DataFrame, index: bm25.Index, size: int) -> DataFrame:
    """:func:`_fill_values`, worked out once for all questions that ask a column for the same weighted words."""
    words = F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("words")
    asked = materialise(index.weights.groupBy(*PAIR_KEY).agg(words), "asked-words-of-columns")
    first = materialise(asked.groupBy(*COLUMN_KEY, "words").agg(F.min("sql_idx").alias("first")), "first-questions")
    firsts = if_small(materialise(first.select(F.col("first").alias("sql_idx"), *COLUMN_KEY), "first-keys"))
    weights = materialise(index.weights.join(firsts, PAIR_KEY, "left_semi"), "first-weights")
    fill = _fill_values(stored, replace(index, weights=weights), size).withColumnRenamed("sql_idx", "first")
    found = materialise(fill.join(first, ["first", *COLUMN_KEY]).drop("first"), "shared-fill")
    return spread_join(asked, found, [*COLUMN_KEY, "words"], "sql_idx").select(*PAIR_KEY, "fill")


def _fill_values(stored: DataFrame, index: bm25.Index, size: int) -> DataFrame:
    """First ``size`` values by (score descending, value) where a question shares a word with a column.

    Worked out on places: the best positive ones, then the first free places of the column. Texts
    are fetched for the result only. Questions and columns without a common word are left out: the
    first values of the column are theirs.
    """
    tops = bm25.top_values(index, size).where("score > 0")
    high = tops.groupBy(*PAIR_KEY).agg(F.sort_array(F.collect_list(F.struct("rank", "place")))["place"].alias("high"))
    if index.has_low:
        high = high.join(F.broadcast(index.low), COLUMN_KEY, "left_anti")
    places = high.join(F.broadcast(index.stats), COLUMN_KEY).select(
        *PAIR_KEY, F.slice(F.concat("high", _free_places(size)), 1, size).alias("places")
    )
    if index.has_low:
        places = places.unionByName(_low_places(index, size))
    long_rows = places.select(*PAIR_KEY, F.posexplode("places").alias("n", "place"))
    needed = long_rows.select(*VALUE_KEY).distinct()
    texts = materialise(stored.join(needed, VALUE_KEY, "left_semi").select(*VALUE_KEY, "value"), "fill")
    return (
        spread_join(long_rows, texts, VALUE_KEY, "sql_idx")
        .groupBy(*PAIR_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("n", "value")))["value"].alias("fill"))
    )


def _low_places(index: bm25.Index, size: int) -> DataFrame:
    """(sql_idx, column, places) in columns where scores may be negative.

    Free places are found by counting: of the stretches of ``_STRETCH`` places that are not all
    scored, the first ``size`` hold enough of them, and only their scored places are looked at.
    """
    weights = index.weights.join(F.broadcast(index.low), COLUMN_KEY, "left_semi")
    scored = materialise(bm25.score_all(index, weights).where("score <> 0"), "low-scores")
    pairs = scored.select(*PAIR_KEY).distinct().join(F.broadcast(index.stats), COLUMN_KEY)
    ends = scored.withColumn("sign", F.signum("score").cast("int"))
    ends = ends.withColumn("rank", F.row_number().over(bm25.best_first(*PAIR_KEY, "sign"))).where(F.col("rank") <= size)
    in_order = lambda sign: F.sort_array(
        F.collect_list(F.when(F.col("sign") == sign, F.struct("rank", "place")))
    )["place"]
    ends = ends.groupBy(*PAIR_KEY).agg(in_order(1).alias("high"), in_order(-1).alias("low"))
    stretch = F.floor((F.col("place") - 1) / _STRETCH).alias("stretch")
    full = (
        scored.groupBy(*PAIR_KEY, stretch)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") == _STRETCH)
        .groupBy(*PAIR_KEY)
        .agg(F.collect_list("stretch").alias("full"))
    )
    none = F.array().cast("array<bigint>")
    taken_up = F.coalesce(F.col("full"), none)
    last = F.floor((F.col("n_values") - 1) / _STRETCH)
    reach = F.least(last, F.lit(size) + F.size(taken_up))
    open_ = pairs.join(full, PAIR_KEY, "left").select(
        *PAIR_KEY,
        "n_values",
        F.explode(F.slice(F.array_except(F.sequence(F.lit(0).cast("long"), reach), taken_up), 1, size)).alias("stretch"),
    )
    own = scored.select(*PAIR_KEY, stretch, "place")
    used = open_.join(own, [*PAIR_KEY, "stretch"], "left").groupBy(*PAIR_KEY, "stretch", "n_values").agg(
        F.collect_list("place").alias("used")
    )
    first = F.col("stretch") * _STRETCH + 1
    within = F.sequence(first, F.least(F.col("n_values"), first + (_STRETCH - 1)))
    free = used.select(*PAIR_KEY, F.slice(F.array_except(within, "used"), 1, size).alias("free"))
    free = free.groupBy(*PAIR_KEY).agg(F.slice(F.sort_array(F.flatten(F.collect_list("free"))), 1, size).alias("free"))
    return (
        pairs.join(ends, PAIR_KEY, "left")
        .join(free, PAIR_KEY, "left")
        .select(*PAIR_KEY, F.slice(F.concat("high", F.coalesce("free", none), "low"), 1, size).alias("places"))
    )
