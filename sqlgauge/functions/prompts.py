"""Prompt templates, and prompts as columns.

Each template takes exactly the fields its caller passes; a field that is not
known for a sample leaves its line out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge.functions.text import squeeze_lines, strip
from sqlgauge.functions.wordlists import LONG_PROMPT_TOKENS

_SCHEMA = "### Tables with their columns and sample values:\n#\n{schema}\n#\n{foreign_keys}\n#\n"
_QUESTION = "### Question: {question}\n### External knowledge: {knowledge}\n"

DRAFT = "### Write one SQL query and nothing else.\n" + _SCHEMA + _QUESTION + "SELECT"
DRAFT_ANALYSED = (
    "### Write one SQL query and nothing else.\n"
    + _SCHEMA
    + "### About the schema: {explanation}\n"
    "### Rules: use only listed tables, columns and keys; selected columns have to fit the "
    "grouping; prefer set operations to long conditions; find extremes by ORDER BY and LIMIT 1.\n"
    + _QUESTION
    + "### Analysis: {analysis}\nSELECT"
)
UNDERSTAND = "### Explain the question: what does each value in it refer to?\n" + _QUESTION
REFLECT = (
    "### The SQL query below fails. What is the likely reason?\n"
    + _SCHEMA + _QUESTION + "{previous_information}\n### Error Reason:"
)
CORRECT = (
    "### The SQL query below fails. Write the corrected query and nothing else.\n"
    + _SCHEMA + _QUESTION + "{previous_information}\n### Correct SQL: SELECT"
)
JUDGE = (
    "### Judge the SQL query by its result. Repeat it if it is right, else write the right "
    "one. An empty or zero result usually means the query is wrong.\n"
    + _SCHEMA + _QUESTION + "### SQL: {sql}\n### Result: {result}\nSELECT"
)
LINK_SCHEMA = (
    "### Name the tables and columns needed to answer the question, as a dictionary from "
    "table to columns. Include those needed only for joins.\n"
    + _SCHEMA + _QUESTION + "### Tables and columns:"
)
RANK_COLUMNS = (
    "### Rank the {num} numbered columns by relevance to the question, as [a] > [b] > ... "
    "and count join columns as relevant.\n" + _SCHEMA + _QUESTION + "### Ranking:"
)
SELECT_COLUMNS = (
    "### Cut the ranking of the {num} numbered columns after the last relevant one.\n"
    + _SCHEMA + _QUESTION + "### Ranking: {ranking}\n### Kept:"
)
TRAIN = (
    "Below are an instruction and its input. Write a fitting response.\n\n"
    "### Instruction:\nJudge the SQL query by its result. Repeat it if it is right, else "
    "write the right one.\n\n### Input:\n"
    + _SCHEMA + _QUESTION + "### SQL: {sql}\n### Result: {result}\n\n### Response:\n"
)
CLASSIFY_ERROR = (
    "### Name the error categories of the wrong query: 1 schema linking, 2 join, 3 grouping, "
    "4 nesting, 5 other. Ignore the case of names.\n"
    + _SCHEMA + _QUESTION
    + "### Wrong SQL: {error}\n### Its result: {error_result}\n"
    "### Right SQL: {sql}\n### Its result: {result}\n### Categories:"
)
NEW_EXAMPLE = (
    "### Write a similar example. Answer with the lines 'New Question: ', "
    "'New External Knowledge: ' and 'New Gold SQL: '.\n"
    + _SCHEMA + _QUESTION + "### Gold SQL: {sql}"
)


def fill(template: str, **fields: Column) -> Column:
    """The template as a column; a line with a NULL or unknown field is left out.

    A field is inserted once and never searched for further fields.
    """
    lines = []
    for line in template.split("\n"):
        pieces = re.split(r"\{(\w+)\}", line)
        parts = [
            fields.get(p, F.lit(None).cast("string")) if i % 2 else F.lit(p)
            for i, p in enumerate(pieces)
            if i % 2 or p
        ]
        lines.append(F.concat(*parts) if parts else F.lit(""))
    text = F.array_join(F.array_compact(F.array(*lines)), "\n")
    return squeeze_lines(strip(text))


def token_estimate(prompt: Column) -> Column:
    """Number of tokens, counted as word pieces of up to six letters, digit
    groups of up to three and single other signs."""
    pattern = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
    return F.regexp_count(prompt, F.lit(pattern))


def is_long(prompt: Column, tokens: Column | None = None) -> Column:
    """Does the prompt go to the long-context model?"""
    count = token_estimate(prompt) if tokens is None else tokens
    return count >= LONG_PROMPT_TOKENS


def between_markers(text: Column, start: str, end: str | None = None) -> Column:
    """Text after ``start`` and before ``end``, stripped."""
    stop = rf"(?=\Q{end}\E|\z)" if end else r"\z"
    return strip(F.regexp_extract(text, rf"(?s)\Q{start}\E(.*?){stop}", 1))


def parse_new_example(reply: Column, with_knowledge: bool) -> Column:
    """struct<question, knowledge, sql> of a reply to :data:`NEW_EXAMPLE`."""
    question_end = "New External Knowledge:" if with_knowledge else "New Gold SQL:"
    knowledge = (
        between_markers(reply, "New External Knowledge: ", "New Gold SQL:")
        if with_knowledge
        else F.lit(None).cast("string")
    )
    return F.struct(
        between_markers(reply, "New Question: ", question_end).alias("question"),
        knowledge.alias("knowledge"),
        between_markers(reply, "New Gold SQL: ").alias("sql"),
    )
