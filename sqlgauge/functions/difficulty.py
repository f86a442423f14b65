"""Difficulty class of a query: substring counts over fixed operator groups.

The counts are over raw text, so ``in`` also counts inside ``join`` and ``or``
inside ``order``; that is how the metric is defined.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge.functions.text import let
from sqlgauge.functions.wordlists import COUNTED_OPS

SIMPLE_LIMIT = 6


def occurrences(text: Column, part: str) -> Column:
    """Number of non-overlapping occurrences of ``part``."""
    removed = F.replace(text, F.lit(part), F.lit(""))
    return ((F.char_length(text) - F.char_length(removed)) / len(part)).cast("int")


def _counted_text(sql: Column) -> Column:
    text = F.lower(sql)
    for star in ("(*)", "( * )"):
        text = F.replace(text, F.lit(star), F.lit(""))
    return text


def operator_count(sql: Column) -> Column:
    """Occurrences of all counted operators."""
    text = _counted_text(sql)
    return reduce(add, [occurrences(text, op) for op in COUNTED_OPS])


def table_count(sql: Column) -> Column:
    """Distinct words that follow ``from`` or ``join``."""
    def following(words: Column) -> Column:
        after = F.transform(
            words, lambda w, i: F.when(w.isin("from", "join"), F.get(words, i + 1))
        )
        return F.size(F.array_distinct(F.array_compact(after)))

    return let(F.filter(F.split(_counted_text(sql), r"\s+"), lambda w: w != ""), following)


def difficulty(sql: Column) -> Column:
    """``simple``, ``moderate`` or ``challenging``."""
    one_table = table_count(sql) == 1
    few = operator_count(sql) <= SIMPLE_LIMIT
    return (
        F.when(one_table & few, "simple").when(one_table, "moderate").otherwise("challenging")
    )
