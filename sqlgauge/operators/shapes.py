"""Statements that differ only in whole numbers, run as one.

The slots of a statement are the whole numbers that its columns are compared with (``name = 17``), its
*shape* is the text without them. All statements of a shape are one lateral join: the text stays as it
is, with columns of the frame of numbers in its slots. Spark turns that into an equi-join, so a table is
read once for all of them. A slot is what an INT literal is, so types and results are the same.

Only texts that select from one relation (projection, filter, DISTINCT, ORDER BY) are shared, and only if
no step of the plan makes a product of numbers and rows; all others keep a plan of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions.dialect import to_spark_sql

# the last lookahead: an even number of quotes follows, so the slot is not in a string
_SLOT = (
    r"(?<=[A-Za-z0-9_])([ \t\r\n]*=[ \t\r\n]*)([0-9]{1,9})(?![0-9A-Za-z_.])"
    r"(?=(?:[^']*'[^']*')*[^']*$)"
)
# other quotes, escapes and comments leave open what is a string; a question mark stands for a slot
_OPAQUE = r"[\"`\\?]|--|/\*"
_LONGEST = 10_000
_FIRST_MARK = 2_000_000_000  # an INT literal, of too many digits to be a slot
_KINDS = {"Project", "Filter", "Sort", "Distinct", "SubqueryAlias", "View"}
_PRODUCTS = ("NestedLoopJoin", "CartesianProduct")


def slots_of(texts: list[str]) -> Column:
    """The numbers in the slots of the text columns, in their order."""
    found = [F.regexp_extract_all(F.col(t), F.lit(_SLOT), F.lit(2)) for t in texts]
    return F.concat(*found).cast("array<int>")


def shape_of(texts: list[str]) -> Column:
    """The text columns without the numbers in their slots; NULL if there are none or they cannot be told."""
    clear = F.size(slots_of(texts)) > 0
    for t in texts:
        clear = clear & ~F.col(t).rlike(_OPAQUE) & (F.char_length(t) <= _LONGEST)
    masked = [F.regexp_replace(F.col(t), F.lit(_SLOT), F.lit("$1?")) for t in texts]
    return F.when(clear, F.to_json(F.array(*masked)))


def _marked(text: str, first: int) -> tuple[str, int]:
    """The text with marks in its slots, numbered from ``first``, and the number of the next slot."""
    parts = re.split(_SLOT, text)  # text, sign, number, text, sign, number, ..., text
    marked = parts[0]
    for i in range(1, len(parts), 3):
        marked += f"{parts[i]}{_FIRST_MARK + first}{parts[i + 2]}"
        first += 1
    return marked, first


def looked_up(tables: dict[str, list[str]], texts: list[str]) -> tuple[tuple[str, str], ...]:
    """(table, column) of the first slot of each table that the texts name."""
    found: dict[str, str] = {}
    for text in texts:
        words = {w.lower() for w in re.findall(r"\w+", text)}
        for slot in re.finditer(_SLOT, text):
            name = re.search(r"\w+$", text[: slot.start()]).group(0).lower()
            for table, columns in tables.items():
                column = next((c for c in columns if c.lower() == name), None)
                if column and table.lower() in words:
                    found.setdefault(table, column)
    return tuple(sorted(found.items()))


def shared_frames(executor, db_id: str, texts: list[str], view: str) -> list[DataFrame] | None:
    """Results (statement, c0, c1, ...) of all statements whose slots are in ``view``; None if they cannot be shared.

    ``texts`` are those of one statement, ``view`` has (statement, slot_0, slot_1, ...).
    """
    frames, at = [], 0
    session, names, integers = executor.opened(db_id)
    for text in texts:
        marked, after = _marked(text, at)
        own = to_spark_sql(marked, names, integers)
        shared = own
        for i in range(at, after):
            mark = str(_FIRST_MARK + i)
            if own.count(mark) != 1:
                return None
            shared = shared.replace(mark, f"{view}.slot_{i}")
        alone = session.sql(own)
        if not _selects_from_one(alone):
            return None
        frame = session.sql(f"SELECT {view}.statement, q.* FROM global_temp.{view} AS {view}, LATERAL ({shared}) AS q")
        if any(p in frame._jdf.queryExecution().sparkPlan().toString() for p in _PRODUCTS):
            return None
        frames.append(frame.toDF("statement", *[f"c{i}" for i in range(len(alone.columns))]))
        at = after
    return frames


def _selects_from_one(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size():
        if plan.children().size() > 1 or plan.nodeName() not in _KINDS:
            return False
        plan = plan.children().apply(0)
    return True


def order_of(executor, db_id: str, text: str) -> list[Column] | None:
    """The order that a statement asks for, by columns c0, c1, ... of its result; None if there is none such."""
    plan = executor.query(db_id, text)._jdf.queryExecution().analyzed()
    if plan.nodeName() != "Sort":
        return None
    output = plan.output()
    places = {output.apply(i).exprId().id(): i for i in range(output.size())}
    found = []
    for i in range(plan.order().size()):
        order = plan.order().apply(i)
        if order.child().nodeName() != "AttributeReference":
            return None
        column = F.col(f"c{places[order.child().exprId().id()]}")
        down, first = order.direction().toString() == "Descending", order.nullOrdering().toString() == "NullsFirst"
        directed = (
            (column.desc_nulls_first if first else column.desc_nulls_last)
            if down
            else (column.asc_nulls_first if first else column.asc_nulls_last)
        )
        found.append(directed())
    return found
