"""BM25 over postings ordered by impact: scores, and the best values without scoring all pairs.

The impact of a word in a value is its share of the score before the word's weight. Postings are
kept in blocks of nearly equal impact (``_LEVELS`` to the unit), each with its greatest impact.
The best k values of a question are found by thresholds, rare words first:

1. The blocks that can add most are scored in full, a few times k postings of them. The k-th best
   score found there is a threshold that no value among the best k falls below.
2. The words of the question are put in the order of the most that each can add. A value whose
   last word in that order is w scores at most what its block of w adds, and the most of all words
   before w. Only blocks that reach the threshold this way yield candidates: common words, first
   in the order, yield none, and values that share nothing else are never met.
3. Candidates are scored in full.

Nothing is estimated: bounds hold for every value, negative weights included, and a question with
fewer than k scored values keeps all its blocks. Texts are not moved: words are counted in the task that
reads them and only words of the questions leave it.

Postings are stored as counts, one row per value and word, and impacts are worked out where they are
read. The blocks of a word that a question keeps are a range of levels, and pairs meet the postings of
their value: they move once at most then, and not at all if what they meet is small enough to be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqlgauge.functions.wordlists import BM25_B, BM25_EPSILON, BM25_K1
from sqlgauge.operators.joins import BROADCAST_BYTES, if_small, measured_bytes, spread_join
from sqlgauge.session import drop_shuffles, materialise, task_count

COLUMN_KEY = ["db_id", "table_name", "column_name"]
VALUE_KEY = [*COLUMN_KEY, "place"]
PAIR_KEY = ["sql_idx", *COLUMN_KEY]
WORD_KEY = [*COLUMN_KEY, "token"]
_LEVELS = 32
_FIRST_PART = 4  # times k: postings scored for the first threshold
_SLACK = 1e-8  # scores are rounded to nine places
_TASK_ROWS = 1 << 21  # pairs of a question's word and a value that holds it, for one task


@dataclass
class Index:
    """Postings of the words of some questions, and the words' weights in each question."""

    postings: DataFrame  # (column, place, token, impact, level)
    weights: DataFrame  # (sql_idx, column, token, weight)
    stats: DataFrame  # (column, n_values, mean_length)
    low: DataFrame  # columns in which words have a negative weight
    has_low: bool


def words_of(text: Column) -> Column:
    return F.split(text, " ")


def column_stats(stored: DataFrame) -> DataFrame:
    """(column, n_values, mean_length): one row per column."""
    return stored.groupBy(*COLUMN_KEY).agg(
        F.count(F.lit(1)).alias("n_values"),
        F.avg(F.size(words_of(F.col("value")))).alias("mean_length"),
    )


def _counted(stored: DataFrame, words: DataFrame) -> DataFrame:
    """(column, place, length, token, tf) of the given words.

    All words of a value are in one task, so counts are complete before the shuffle.
    """
    split = stored.select(*VALUE_KEY, words_of(F.col("value")).alias("words"))
    rows = split.select(*VALUE_KEY, F.size("words").alias("length"), F.explode("words").alias("token"))
    counted = lambda df: df.groupBy(*VALUE_KEY, "length", "token").agg(F.count(F.lit(1)).alias("tf"))
    if measured_bytes(words) <= BROADCAST_BYTES:
        return counted(rows.join(F.broadcast(words), ["db_id", "token"], "left_semi"))
    return counted(rows).join(words.hint("merge"), ["db_id", "token"], "left_semi")


def _negative_floor(stored: DataFrame, low: DataFrame, stats: DataFrame) -> DataFrame:
    """(column, floor): a quarter of the mean idf over all words of the column."""
    every = F.explode(F.array_distinct(words_of(F.col("value")))).alias("token")
    counts = (
        stored.join(F.broadcast(low), COLUMN_KEY, "left_semi")
        .select(*COLUMN_KEY, every)
        .groupBy(*WORD_KEY)
        .agg(F.count(F.lit(1)).alias("df"))
    )
    weighted = counts.join(F.broadcast(stats), COLUMN_KEY).withColumn("idf", _idf())
    return weighted.groupBy(*COLUMN_KEY).agg((F.avg("idf") * BM25_EPSILON).alias("floor"))


def _idf() -> Column:
    return F.ln(F.col("n_values") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)


def build_index(questions: DataFrame, stored: DataFrame) -> Index:
    """Postings and weights for ``questions`` (sql_idx, db_id, question) over ``stored`` values."""
    # one row per column: the schema bounds these frames
    stats = materialise(column_stats(stored), "stats")
    asked = materialise(
        questions.select("sql_idx", "db_id", F.explode(words_of(F.col("question"))).alias("token"))
        .groupBy("sql_idx", "db_id", "token")
        .agg(F.count(F.lit(1)).alias("qtf")),
        "asked",
    )
    words = materialise(asked.select("db_id", "token").distinct(), "asked-words")
    spread = F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean_length"))
    tallies = materialise(_counted(stored, words), "postings")
    postings = (
        tallies.join(F.broadcast(stats.drop("n_values")), COLUMN_KEY)
        .select(*VALUE_KEY, "token", (F.col("tf") * (BM25_K1 + 1) / spread).alias("impact"))
        .withColumn("level", F.floor(F.col("impact") * _LEVELS).cast("int"))
    )
    counts = tallies.groupBy(*WORD_KEY).agg(F.count(F.lit(1)).alias("df"))
    raw = materialise(
        counts.join(F.broadcast(stats.drop("mean_length")), COLUMN_KEY).select(*WORD_KEY, _idf().alias("idf")),
        "idf",
    )
    low = materialise(raw.where("idf < 0").select(*COLUMN_KEY).distinct(), "low-columns")
    has_low = not low.isEmpty()
    if has_low:
        floors = _negative_floor(stored, low, stats)
        raw = raw.join(F.broadcast(floors), COLUMN_KEY, "left").withColumn(
            "idf", F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf"))
        )
    vocabulary = materialise(raw.select(*WORD_KEY, "idf"), "vocabulary")
    weights = materialise(
        spread_join(asked, vocabulary, ["db_id", "token"], "sql_idx").select(
            *PAIR_KEY, "token", (F.col("qtf") * F.col("idf")).alias("weight")
        ),
        "weights",
    )
    drop_shuffles(questions.sparkSession)
    below = vocabulary.where("idf < 0").select(*COLUMN_KEY).distinct()
    low = materialise(below, "low-columns") if has_low else low
    return Index(postings, weights, stats, low, has_low and not low.isEmpty())


def _summed(rows: DataFrame) -> DataFrame:
    """Scores rounded to nine places, so that the order of summation does not show."""
    return rows.groupBy(*VALUE_KEY, "sql_idx").agg(F.round(F.sum("part"), 9).alias("score")).select(
        *PAIR_KEY, "place", "score"
    )


def score_all(index: Index, weights: DataFrame | None = None) -> DataFrame:
    """(sql_idx, column, place, score) of every value that shares a word with a question.

    If the postings can be broadcast, the words of a question stay together in one task and are summed up
    there: the pairs, by far the longest frame, are not shuffled. Tasks are as many as the met pairs need.
    """
    weights = index.weights if weights is None else weights
    postings = index.postings.drop("level")
    if measured_bytes(postings) <= BROADCAST_BYTES:
        spark = postings.sparkSession
        asked = weights.groupBy(*WORD_KEY).agg(F.count(F.lit(1)).alias("n"))
        held = postings.groupBy(*WORD_KEY).agg(F.count(F.lit(1)).alias("m"))
        n_met = asked.join(held, WORD_KEY).agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0))).first()[0]
        tasks = max(task_count(spark), -(-n_met // _TASK_ROWS))
        met = weights.repartition(tasks, "sql_idx").join(F.broadcast(postings), WORD_KEY)
    else:
        met = spread_join(index.postings, weights, WORD_KEY, "place")
    return _summed(met.withColumn("part", F.col("weight") * F.col("impact")))


def texts_met(index: Index, stored: DataFrame) -> DataFrame:
    """(column, place, value) of the values that hold a word of any question."""
    held = if_small(materialise(index.postings.select(*VALUE_KEY).distinct(), "values-met"), BROADCAST_BYTES)
    return materialise(stored.select(*VALUE_KEY, "value").join(held, VALUE_KEY, "left_semi"), "texts-met")


def score_pairs(index: Index, pairs: DataFrame) -> DataFrame:
    """Scores of chosen pairs (sql_idx, column, place); pairs without a common word are left out."""
    pairs = if_small(materialise(pairs.select(*PAIR_KEY, "place"), "pairs"), BROADCAST_BYTES)
    words = index.postings.drop("level").join(pairs, VALUE_KEY)
    met = spread_join(words, index.weights, [*PAIR_KEY, "token"], "place")
    return _summed(met.withColumn("part", F.col("weight") * F.col("impact")))


def best_first(*keys: str) -> W:
    return W.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("place"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    ranked = scores.withColumn("rank", F.row_number().over(best_first(*PAIR_KEY)))
    return ranked.where(F.col("rank") <= k)


def _question_blocks(index: Index) -> DataFrame:
    """(sql_idx, column, token, level, n, most, word_most): what a block and its word add at most.

    One row per word of a question, column and level of impact.
    """
    blocks = index.postings.groupBy(*WORD_KEY, "level").agg(
        F.count(F.lit(1)).alias("n"), F.max("impact").alias("top"), F.min("impact").alias("bottom")
    )
    tops = F.max("top").over(W.partitionBy(*WORD_KEY))
    blocks = materialise(blocks.withColumn("word_top", tops), "blocks")
    adds = lambda c: F.col("weight") * F.col(c)
    return spread_join(index.weights, blocks, WORD_KEY, "sql_idx").select(
        *PAIR_KEY, "token", "level", "n",
        F.greatest(adds("top"), adds("bottom")).alias("most"), F.greatest(adds("word_top"), F.lit(0.0)).alias("word_most")
    )


def _met(index: Index, blocks: DataFrame) -> DataFrame:
    """Distinct (sql_idx, column, place) of the postings in some blocks of the questions.

    ``blocks`` is (sql_idx, column, token, low, high): the levels of a word from ``low`` to ``high``.
    """
    keys = materialise(blocks.select("sql_idx", *WORD_KEY, "low", "high"), "kept-blocks")
    met = spread_join(index.postings.drop("impact"), keys, WORD_KEY, "place")
    return met.where(F.col("level").between(F.col("low"), F.col("high"))).select(*PAIR_KEY, "place").distinct()


def _threshold(index: Index, blocks: DataFrame, k: int) -> DataFrame:
    """(sql_idx, column, threshold): a score that k values reach; pairs without one are left out."""
    order = W.partitionBy(*PAIR_KEY).orderBy(F.col("most").desc(), "token", "level")
    so_far = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
    # a block longer than the whole budget is left for the candidates
    first = blocks.where(F.col("n") <= _FIRST_PART * k).withColumn("so_far", so_far)
    first = first.where(F.col("so_far") <= 2 * _FIRST_PART * k)
    tried = _met(index, first.withColumn("low", F.col("level")).withColumn("high", F.col("level")))
    best = _best(score_pairs(index, tried), k)
    return best.where(F.col("rank") == k).select(*PAIR_KEY, F.col("score").alias("threshold"))


def candidates(index: Index, k: int) -> DataFrame:
    """(sql_idx, column, place) of all values that may be among the best ``k`` of a question."""
    blocks = materialise(_question_blocks(index), "question-blocks")
    known = materialise(_threshold(index, blocks, k), "thresholds")
    # the most that all words before this one add; all blocks of a word have the same
    words = blocks.select(*PAIR_KEY, "token", "word_most").distinct()
    order = W.partitionBy(*PAIR_KEY).orderBy("word_most", "token").rowsBetween(W.unboundedPreceding, -1)
    words = words.select(*PAIR_KEY, "token", F.coalesce(F.sum("word_most").over(order), F.lit(0.0)).alias("others"))
    reach = F.col("most") + F.col("others") >= F.col("threshold") - _SLACK
    # higher levels add more, or less if the weight is negative, so what is kept is a range
    kept = (
        blocks.join(words, [*PAIR_KEY, "token"])
        .join(known, PAIR_KEY, "left")
        .where(F.col("threshold").isNull() | reach)
        .groupBy(*PAIR_KEY, "token")
        .agg(F.min("level").alias("low"), F.max("level").alias("high"))
    )
    return _met(index, kept)


def top_values(index: Index, k: int) -> DataFrame:
    """The ``k`` best scored values per question and column, ties in value order, with their rank."""
    return _best(score_pairs(index, candidates(index, k)), k)
