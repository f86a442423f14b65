"""Which tables and columns of a schema a query uses, and schema pruning.

All operators work row by row on (query text, nested schema) and are native
expressions. A sample meets its schema by an equi-join on ``db_id``.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions.text import (
    let,
    natsql_tokens,
    natsql_used_columns,
    normalize_sql,
    split_words,
)
from sqlgauge.operators.joins import spread_join
from sqlgauge.session import materialise

_SRC_T, _SRC_C = "source_table_name_original", "source_column_name_original"
_DST_T, _DST_C = "target_table_name_original", "target_column_name_original"


def _tables(schema_items: Column) -> Column:
    return F.transform(schema_items, lambda t: t["table_name_original"])


def with_schema(samples: DataFrame, schemas: DataFrame) -> DataFrame:
    """Attach the schema of its database to every sample.

    The schemas are written first: they are made once, and their size is known
    when the join is planned. A database of many samples is no hot key.
    """
    return spread_join(samples, materialise(schemas, "schemas"), ["db_id"], "sql_idx")


# --- labels ----------------------------------------------------------------


def sql_labels(norm_sql: Column, schema_items: Column) -> tuple[Column, Column]:
    """(table_labels, column_labels): 1 where the canonical query names the item."""
    words = split_words(norm_sql)
    return _labels(schema_items, words, words, dotted_only=False)


def natsql_labels(norm_natsql: Column, schema_items: Column) -> tuple[Column, Column]:
    """The same for NatSQL, where columns are always written ``table.column``."""
    words, used = natsql_tokens(norm_natsql), natsql_used_columns(norm_natsql)
    return _labels(schema_items, words, used, dotted_only=True)


def _column_words(words: Column, table: Column, dotted_only: bool) -> Column:
    """Words that can name a column of ``table``; ``table.x`` also counts as ``x``."""
    prefix = F.concat(table, F.lit("."))
    own = F.transform(
        F.filter(words, lambda w: F.startswith(w, prefix)),
        lambda w: F.substr(w, F.char_length(prefix) + 1),
    )
    return own if dotted_only else F.concat(words, own)


def _labels(
    schema_items: Column, table_words: Column, column_words: Column, dotted_only: bool
) -> tuple[Column, Column]:
    def tables(words: Column) -> Column:
        return F.transform(
            schema_items, lambda t: F.array_contains(words, t["table_name_original"]).cast("int")
        )

    def columns(bound: Column) -> Column:
        def of_table(t: Column) -> Column:
            names = t["column_names_original"]
            labels = let(
                _column_words(bound["c"], t["table_name_original"], dotted_only),
                lambda own: F.transform(names, lambda c: F.array_contains(own, c).cast("int")),
            )
            used = F.array_contains(bound["t"], t["table_name_original"])
            return F.when(used, labels).otherwise(F.array_repeat(F.lit(0), F.size(names)))

        return F.transform(schema_items, of_table)

    both = F.struct(table_words.alias("t"), column_words.alias("c"))
    return let(table_words, tables), let(both, columns)


def used_columns(sql: Column, schema_items: Column) -> Column:
    """``array<struct<table_name, columns>>`` named by the query, in schema order."""
    def columns(words: Column) -> Column:
        used = F.filter(schema_items, lambda t: F.array_contains(words, t["table_name_original"]))
        return F.transform(
            used,
            lambda t: F.struct(
                t["table_name_original"].alias("table_name"),
                let(
                    _column_words(words, t["table_name_original"], dotted_only=False),
                    lambda own: F.filter(
                        t["column_names_original"], lambda c: F.array_contains(own, c)
                    ),
                ).alias("columns"),
            ),
        )

    return let(split_words(normalize_sql(sql)), columns)


# --- table selection along the foreign keys --------------------------------


def named_tables(sql: Column, schema_items: Column) -> Column:
    """Tables whose name is a word of the query, with or without one mark at the word's end.

    If no word is a table's name, all tables.
    """
    names = _tables(schema_items)
    words = F.split(F.lower(sql), r"\s+")
    either = let(
        words, lambda ws: F.concat(ws, F.transform(ws, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]$", "")))
    )
    found = F.array_intersect(names, either)
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(names))


def with_neighbors(tables: Column, fk: Column) -> Column:
    """The tables and those one foreign key away."""
    def expand(bound: Column) -> Column:
        other = F.transform(
            fk,
            lambda k: F.when(F.array_contains(bound, k[_SRC_T]), k[_DST_T]).when(
                F.array_contains(bound, k[_DST_T]), k[_SRC_T]
            ),
        )
        return F.sort_array(F.array_union(bound, F.array_compact(other)))

    return let(tables, expand)


def first_path(
    edges: Iterable[tuple[str, str]], start: str, end: str
) -> list[str] | None:
    """First path of a depth-first walk over an undirected graph, in edge order.

    A node left without success is not entered again: whatever it leads to besides the path
    has been tried, so the walk takes linear time.
    """
    graph: dict[str, list[str]] = {}
    for a, b in edges:
        graph.setdefault(a, []).append(b)
        graph.setdefault(b, []).append(a)
    if start == end:
        return [start]
    path, pending, met = [start], [iter(graph.get(start, []))], {start}
    while pending:
        node = next((n for n in pending[-1] if n not in met), None)
        if node is None:
            pending.pop()
            path.pop()
        elif node == end:
            return [*path, node]
        else:
            path.append(node)
            met.add(node)
            pending.append(iter(graph.get(node, [])))
    return None


_PATHS_DDL = "array<struct<a:string,b:string,path:array<string>>>"


def _paths_of(keys: Iterable[dict]) -> list[dict]:
    """Paths between all pairs of tables of one schema that no key joins directly."""
    edges = [(k[_SRC_T], k[_DST_T]) for k in keys]
    joined = {frozenset(e) for e in edges}
    tables = sorted({t for e in edges for t in e})
    found = []
    for i, a in enumerate(tables):
        for b in tables[i + 1 :]:
            path = None if frozenset((a, b)) in joined else first_path(edges, a, b)
            if path:
                found.append({"a": a, "b": b, "path": path})
    return found


def with_paths(schemas: DataFrame) -> DataFrame:
    """Add ``paths``: the join path of each pair of tables no key joins directly.

    Computed once per schema; samples only look their pairs up.
    """
    @F.pandas_udf(_PATHS_DDL)
    def paths(fk: pd.Series) -> pd.Series:
        return fk.map(_paths_of)

    return schemas.withColumn("paths", paths(F.col("fk")))


def connected_tables(
    tables: Column, fk: Column, paths: Column, below: int | None = None
) -> Column:
    """Neighbours, plus the tables on the paths between unconnected pairs.

    With ``below``, paths are only added to selections of fewer tables.
    """
    def connect(near: Column) -> Column:
        between = F.filter(
            paths, lambda p: F.array_contains(near, p["a"]) & F.array_contains(near, p["b"])
        )
        joined = F.flatten(F.transform(between, lambda p: p["path"]))
        whole = F.sort_array(F.array_union(near, joined))
        return whole if below is None else F.when(F.size(near) < below, whole).otherwise(near)

    return let(with_neighbors(tables, fk), connect)


def _distances_of(keys: Iterable[dict]) -> list[dict]:
    """Shortest key distance between all connected pairs of tables of one schema."""
    near: dict[str, set[str]] = {}
    for k in keys:
        near.setdefault(k[_SRC_T], set()).add(k[_DST_T])
        near.setdefault(k[_DST_T], set()).add(k[_SRC_T])
    found = []
    for start in near:
        seen, frontier, depth = {start}, {start}, 0
        while frontier:
            depth += 1
            frontier = {n for t in frontier for n in near[t]} - seen
            seen |= frontier
            found += [{"src": start, "dst": t, "depth": depth} for t in frontier]
    return found


def reachable_tables(schemas: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(db_id, src, dst, depth): shortest foreign-key distance between tables.

    One schema is one row and one small graph; schemas spread over the tasks.
    """
    @F.pandas_udf("array<struct<src:string,dst:string,depth:int>>")
    def distances(fk: pd.Series) -> pd.Series:
        return fk.map(_distances_of)

    rows = schemas.select("db_id", F.explode(distances(F.col("fk"))).alias("d"))
    found = rows.select("db_id", "d.*")
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


# --- column selection ------------------------------------------------------


def mentioned_tables(sql: Column, schema_items: Column) -> Column:
    """Tables whose name occurs anywhere in the text; all tables if none does."""
    names = _tables(schema_items)
    found = let(F.lower(sql), lambda text: F.filter(names, lambda n: F.contains(text, n)))
    return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(names))


def mentioned_columns(sql: Column, schema_items: Column) -> Column:
    """Tables and columns occurring in the text; all columns where none does."""
    def columns(bound: Column) -> Column:
        picked = F.filter(
            schema_items, lambda t: F.array_contains(bound["tables"], t["table_name_original"])
        )
        none = F.array().cast("array<string>")
        return F.transform(picked, lambda t: _columns_in_text(bound["text"], t, none))

    return let(_bound_text(sql, schema_items), columns)


def _bound_text(sql: Column, schema_items: Column) -> Column:
    return F.struct(
        F.lower(sql).alias("text"), mentioned_tables(sql, schema_items).alias("tables")
    )


def _columns_in_text(text: Column, table: Column, key_columns: Column) -> Column:
    found = F.filter(table["column_names_original"], lambda c: F.contains(text, c))
    both = F.sort_array(F.array_union(key_columns, found))
    return F.struct(
        table["table_name_original"].alias("table_name"),
        F.when(F.size(both) > 0, both)
        .otherwise(F.sort_array(table["column_names_original"]))
        .alias("columns"),
    )


def mentioned_columns_with_keys(sql: Column, schema_items: Column, fk: Column) -> Column:
    """The same, with the key columns of every foreign key that touches a table.

    A table that is not mentioned itself comes in through a key, with the key
    column of the last such key.
    """
    def with_ends(bound: Column) -> Column:
        tables = bound["tables"]
        touching = F.filter(
            fk,
            lambda k: F.array_contains(tables, k[_SRC_T]) | F.array_contains(tables, k[_DST_T]),
        )
        ends = F.flatten(
            F.transform(
                touching,
                lambda k: F.array(
                    F.struct(k[_SRC_T].alias("t"), k[_SRC_C].alias("c")),
                    F.struct(k[_DST_T].alias("t"), k[_DST_C].alias("c")),
                ),
            )
        )
        return let(ends, lambda e: columns(bound, e))

    def keys_of(name: Column, tables: Column, ends: Column) -> Column:
        own = F.transform(F.filter(ends, lambda e: e["t"] == name), lambda e: e["c"])
        return let(
            own,
            lambda o: F.array_distinct(
                F.when(
                    (F.size(o) > 0) & ~F.array_contains(tables, name), F.slice(o, F.size(o), 1)
                ).otherwise(o)
            ),
        )

    def columns(bound: Column, ends: Column) -> Column:
        def wanted(name: Column) -> Column:
            return F.array_contains(bound["tables"], name) | F.exists(
                ends, lambda e: e["t"] == name
            )

        picked = F.filter(schema_items, lambda t: wanted(t["table_name_original"]))
        return F.transform(
            picked,
            lambda t: _columns_in_text(
                bound["text"], t, keys_of(t["table_name_original"], bound["tables"], ends)
            ),
        )

    return let(_bound_text(sql, schema_items), with_ends)


# --- keys per table --------------------------------------------------------


def primary_keys_by_table(schemas: DataFrame) -> DataFrame:
    """(db_id, table_name, columns): all columns of a composite key are kept."""
    return (
        schemas.select("db_id", F.posexplode("pk").alias("place", "k"))
        .groupBy("db_id", F.col("k.table_name_original").alias("table_name"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "k.column_name_original"))).alias("c"))
        .select("db_id", "table_name", F.col("c.column_name_original").alias("columns"))
    )


def join_columns_by_table(columns: DataFrame, fks: DataFrame) -> DataFrame:
    """(db_id, table_name, columns): key columns, and names shared with another table.

    Takes the long catalog frames. A shared name is found by counting the tables
    per name, not by pairing all columns.
    """
    ends = fks.select("db_id", F.col("src_table").alias("table_name"),
                      F.col("src_column").alias("column_name")).unionByName(
        fks.select("db_id", F.col("dst_table").alias("table_name"),
                   F.col("dst_column").alias("column_name"))
    )
    shared = (
        columns.groupBy("db_id", "column_name")
        .agg(F.collect_set("table_name").alias("tables"))
        .where(F.size("tables") > 1)
        .select("db_id", F.explode("tables").alias("table_name"), "column_name")
    )
    return (
        ends.unionByName(shared)
        .groupBy("db_id", "table_name")
        .agg(F.sort_array(F.collect_set("column_name")).alias("columns"))
    )


def table_columns(schemas: DataFrame) -> DataFrame:
    """(db_id, table_name, columns) of every table."""
    return schemas.select("db_id", F.explode("schema_items").alias("t")).select(
        "db_id",
        F.col("t.table_name_original").alias("table_name"),
        F.col("t.column_names_original").alias("columns"),
    )
