"""Schemas as prompt text: native string expressions over the nested schema.

``db_schema`` is ``schema_items`` with ``db_contents``, an array of sample
values per column (see ``plans.preprocess``). The published format leaves a
parenthesis open after columns without sample values, and joins the columns of
a selection without a separator; ``exact=True`` reproduces that, the default is
balanced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlgauge.functions.text import let
from sqlgauge.functions.wordlists import MAX_RENDERED_VALUE


def _short_values(values: Column) -> Column:
    return F.filter(values, lambda v: F.char_length(v) < MAX_RENDERED_VALUE)


def _samples(table: Column, index: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.get(table["db_contents"], index), empty)


def _example(values: Column) -> Column:
    """`` ( e.g., `a`, `b`, etc. )``, or nothing without a short value."""
    joined = F.array_join(_short_values(values), "`, `")
    return let(
        joined,
        lambda j: F.when(j == "", "").otherwise(
            F.concat(F.lit(" ( e.g., `"), j, F.lit("`, etc. )"))
        ),
    )


def _column(table: Column, name: Column, index: Column, exact: bool) -> Column:
    values = _samples(table, index)
    text = F.concat(name, _example(values))
    if exact:
        text = F.when(F.size(values) == 0, F.concat(name, F.lit(" ("))).otherwise(text)
    return text


def _table_line(name: Column, columns: Column) -> Column:
    return F.concat(F.lit("# "), name, F.lit(" ( "), F.array_join(columns, ", "), F.lit(" )"))


def foreign_keys_text(fk: Column, tables: Column | None = None) -> Column:
    """``# a.x = b.y`` lines, of all keys or of those within ``tables``."""
    src, dst = "source_table_name_original", "target_table_name_original"
    if tables is not None:
        fk = let(
            tables,
            lambda bound: F.filter(
                fk, lambda k: F.array_contains(bound, k[src]) & F.array_contains(bound, k[dst])
            ),
        )
    line = lambda k: F.concat(
        F.lit("# "), k[src], F.lit("."), k["source_column_name_original"],
        F.lit(" = "), k[dst], F.lit("."), k["target_column_name_original"],
    )
    return F.array_join(F.transform(fk, line), "\n")


def schema_text(db_schema: Column, exact: bool = False) -> Column:
    """One line per table: columns with sample values."""
    def line(t: Column) -> Column:
        columns = F.transform(
            t["column_names_original"], lambda c, i: _column(t, c, i, exact)
        )
        return _table_line(t["table_name_original"], columns)

    return F.array_join(F.transform(db_schema, line), "\n")


def schema_text_simple(db_schema: Column, exact: bool = False) -> Column:
    """One line per table: column names only."""
    suffix = F.lit(" (" if exact else "")

    def line(t: Column) -> Column:
        columns = F.transform(t["column_names_original"], lambda c: F.concat(c, suffix))
        return _table_line(t["table_name_original"], columns)

    return F.array_join(F.transform(db_schema, line), "\n")


def schema_text_by_tables(db_schema: Column, tables: Column) -> Column:
    """:func:`schema_text` of the chosen tables."""
    picked = F.filter(
        db_schema, lambda t: F.array_contains(tables, t["table_name_original"])
    )
    return schema_text(picked)


def _selection(used: Column, name: Column) -> Column:
    hit = F.filter(used, lambda u: u["table_name"] == name)
    return F.coalesce(F.get(hit, F.lit(0))["columns"], F.array().cast("array<string>"))


def schema_text_by_columns(db_schema: Column, used: Column, exact: bool = False) -> Column:
    """Chosen tables and columns in schema order; ``used`` as in ``operators.usage``."""
    chosen_tables = F.transform(used, lambda u: u["table_name"])
    picked = F.filter(
        db_schema, lambda t: F.array_contains(chosen_tables, t["table_name_original"])
    )

    def line(t: Column) -> Column:
        return let(_selection(used, t["table_name_original"]), lambda w: picked_line(t, w))

    def picked_line(t: Column, wanted: Column) -> Column:
        columns = F.filter(
            F.transform(
                t["column_names_original"],
                lambda c, i: F.when(F.array_contains(wanted, c), _column(t, c, i, exact)),
            ),
            lambda text: text.isNotNull(),
        )
        if not exact:
            return _table_line(t["table_name_original"], columns)
        text = F.concat(
            F.lit("# "), t["table_name_original"], F.lit(" ( "), F.array_join(columns, "")
        )
        return F.left(text, F.char_length(text) - 3)

    return F.array_join(F.transform(picked, line), "\n")


def schema_text_in_order(db_schema: Column, used: Column) -> Column:
    """Chosen tables and columns in the order of ``used``."""
    def line(u: Column) -> Column:
        table = F.get(
            F.filter(db_schema, lambda t: t["table_name_original"] == u["table_name"]), F.lit(0)
        )
        return let(table, lambda t: table_line(u, t))

    def table_line(u: Column, table: Column) -> Column:
        def column(c: Column) -> Column:
            place = F.array_position(table["column_names_original"], c)
            values = F.when(place > 0, _samples(table, (place - 1).cast("int"))).otherwise(
                F.array().cast("array<string>")
            )
            return F.concat(c, _example(F.coalesce(values, F.array().cast("array<string>"))))

        return _table_line(u["table_name"], F.transform(u["columns"], column))

    return F.array_join(F.transform(used, line), "\n")


def schema_list_text(db_schema: Column) -> Column:
    """All columns as numbered lines ``# [n]. table.column``."""
    names = F.flatten(
        F.transform(
            db_schema,
            lambda t: F.transform(
                t["column_names_original"],
                lambda c: F.concat(t["table_name_original"], F.lit("."), c),
            ),
        )
    )
    numbered = F.transform(
        names, lambda n, i: F.concat(F.lit("# ["), (i + 1).cast("string"), F.lit("]. "), n)
    )
    return F.array_join(numbered, "\n")


def schema_descriptions(db_schema: Column, knowledge: Column | None = None) -> Column:
    """One description per column: names, descriptions, samples, knowledge."""
    def optional(label: str, text: Column) -> Column:
        return F.when(text != "", F.concat(F.lit(label), text)).otherwise("")

    def describe(t: Column) -> Column:
        def column(c: Column, i: Column) -> Column:
            short = _short_values(_samples(t, i))
            parts = [
                F.lit("table: "), t["table_name_original"], F.lit(", column: "), c,
                optional(", column description: ", F.get(t["column_description"], i)),
                optional(", value description: ", F.get(t["value_description"], i)),
                optional(", sample value: ", F.array_join(short, ", ")),
            ]
            if knowledge is not None:
                parts.append(
                    F.when(
                        F.contains(knowledge, c),
                        F.concat(F.lit(", external knowledge: "), knowledge),
                    ).otherwise("")
                )
            return F.concat(*parts)

        return F.transform(t["column_names_original"], column)

    return F.flatten(F.transform(db_schema, describe))
