"""Schema graph, column selection and rendering on a small schema."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import render
from sqlgauge.operators import usage
from sqlgauge.plans.preprocess import with_contents
from sqlgauge.sources import catalog

RECORD = {
    "db_id": "school",
    "table_names": ["The Students", "Classes", "Takes", "Rooms"],
    "table_names_original": ["Student", "Class", "Takes", "Room"],
    "column_names": [[-1, "*"], [0, "Student ID"], [0, "Full Name"], [1, "Class ID"], [1, "Room"],
                     [2, "Student"], [2, "Class"], [3, "Number"], [3, "Size"]],
    "column_names_original": [[-1, "*"], [0, "SID"], [0, "Name"], [1, "CID"], [1, "RoomNo"],
                              [2, "SID"], [2, "CID"], [3, "Num"], [3, "Size"]],
    "column_types": ["text", "int", "text", "int", "int", "int", "int", "int", "int"],
    "primary_keys": [1, 3, [5, 6], 7],
    "foreign_keys": [[5, 1], [6, 3], [4, 7]],
}


@pytest.fixture(scope="module")
def schemas(spark):
    return catalog.resolve_schemas(catalog.records_frame(spark, [RECORD])).cache()


def one(df, column):
    return df.select(column.alias("x")).first().x


def logged(schemas, sql):
    return schemas.withColumn("sql", F.lit(sql))


def test_resolve(schemas, spark):
    row = schemas.first()
    takes = row.schema_items[2]
    assert takes.column_names_original == ["sid", "cid"]
    assert takes.column_names == ["student", "class"]
    assert [(k.table_name_original, k.column_name_original) for k in row.pk] == [
        ("student", "sid"), ("class", "cid"), ("takes", "sid"), ("takes", "cid"), ("room", "num")
    ]
    assert [tuple(k) for k in row.fk] == [
        ("takes", "sid", "student", "sid"), ("takes", "cid", "class", "cid"),
        ("class", "roomno", "room", "num"),
    ]
    keys = {r.table_name: r["columns"] for r in usage.primary_keys_by_table(schemas).collect()}
    assert keys["takes"] == ["sid", "cid"]
    joins = usage.join_columns_by_table(
        catalog.catalog_columns(schemas), catalog.catalog_fks(schemas)
    )
    assert {r.table_name: r["columns"] for r in joins.collect()} == {
        "student": ["sid"], "class": ["cid", "roomno"], "takes": ["cid", "sid"], "room": ["num"]
    }
    assert {r.table_name for r in usage.table_columns(schemas).collect()} == {
        "student", "class", "takes", "room"
    }
    ids = dict(one(schemas, catalog.name_ids(F.col("schema_items"))))
    assert ids["*"] == "__all__" and ids["takes.sid"] == "__takes.sid__" and ids["room"] == "__room__"


def test_named_tables(schemas):
    items = F.col("schema_items")
    for sql, want in [
        ("SELECT * FROM Student,  Takes;", ["student", "takes"]),
        ("SELECT 1", ["student", "class", "takes", "room"]),
        ("select students from room", ["room"]),
    ]:
        assert one(logged(schemas, sql), usage.named_tables(F.col("sql"), items)) == want


def test_connected_tables(schemas):
    with_paths = usage.with_paths(schemas)
    named = F.array(F.lit("student"), F.lit("room"))
    near = one(with_paths, usage.with_neighbors(named, F.col("fk")))
    assert near == ["class", "room", "student", "takes"]
    only = F.array(F.lit("room"))
    assert one(with_paths, usage.connected_tables(only, F.col("fk"), F.col("paths"))) == ["class", "room"]
    assert usage.first_path([("a", "b"), ("b", "c"), ("a", "c")], "a", "c") == ["a", "b", "c"]
    assert usage.first_path([("a", "b"), ("c", "d")], "a", "d") is None
    reach = {(r.src, r.dst): r.depth for r in usage.reachable_tables(schemas).collect()}
    assert reach[("student", "room")] == 3 and reach[("room", "class")] == 1


def pairs(used):
    return {u.table_name: u["columns"] for u in used}


def test_columns(schemas):
    items, sql = F.col("schema_items"), F.col("sql")
    df = logged(schemas, "SELECT T1.Name FROM Student AS T1 JOIN Takes AS T2 ON T1.SID = T2.SID")
    assert pairs(one(df, usage.used_columns(sql, items))) == {"student": ["sid", "name"], "takes": ["sid"]}
    assert pairs(one(df, usage.mentioned_columns(sql, items))) == {
        "student": ["name", "sid"], "takes": ["sid"]
    }
    # class comes in through a key of takes, with that key's column only.
    assert pairs(one(df, usage.mentioned_columns_with_keys(sql, items, F.col("fk")))) == {
        "student": ["name", "sid"], "class": ["cid"], "takes": ["cid", "sid"]
    }
    nothing = logged(schemas, "SELECT 1")
    assert pairs(one(nothing, usage.mentioned_columns(sql, items)))["room"] == ["num", "size"]


def test_labels(schemas):
    items = F.col("schema_items")
    df = logged(schemas, "select student.name , cid from student join takes on student.sid = takes.sid")
    tables, columns = usage.sql_labels(F.col("sql"), items)
    assert one(df, tables) == [1, 0, 1, 0]
    assert one(df, columns) == [[1, 1], [0, 0], [1, 1], [0, 0]]
    nat = logged(schemas, "select student.name from student where takes.cid = 1")
    tables, columns = usage.natsql_labels(F.col("sql"), items)
    assert one(nat, tables) == [1, 0, 1, 0]
    assert one(nat, columns) == [[0, 1], [0, 0], [0, 1], [0, 0]]


@pytest.fixture(scope="module")
def filled(schemas):
    contents = F.create_map(
        F.lit("student.name"), F.array(F.lit("Ann"), F.lit("Bo")),
        F.lit("room.size"), F.array(F.lit("x" * 100)),
    )
    return schemas.withColumn("db_schema", with_contents(F.col("schema_items"), contents)).cache()


def test_render(filled):
    db, fk = F.col("db_schema"), F.col("fk")
    assert one(filled, render.schema_text(db)).split("\n")[0] == (
        "# student ( sid, name ( e.g., `Ann`, `Bo`, etc. ) )"
    )
    exact = one(filled, render.schema_text(db, exact=True)).split("\n")
    assert exact[0] == "# student ( sid (, name ( e.g., `Ann`, `Bo`, etc. ) )"
    assert exact[3] == "# room ( num (, size )"
    assert one(filled, render.schema_text_simple(db)).split("\n")[3] == "# room ( num, size )"
    assert one(filled, render.schema_text_simple(db, exact=True)).split("\n")[3] == "# room ( num (, size ( )"
    tables = F.array(F.lit("takes"), F.lit("class"))
    assert one(filled, render.schema_text_by_tables(db, tables)) == (
        "# class ( cid, roomno )\n# takes ( sid, cid )"
    )
    assert one(filled, render.foreign_keys_text(fk, tables)) == "# takes.cid = class.cid"
    assert one(filled, render.foreign_keys_text(fk)).count("\n") == 2
    numbered = one(filled, render.schema_list_text(db)).split("\n")
    assert numbered[0] == "# [1]. student.sid" and numbered[-1] == "# [8]. room.size"
    described = one(filled, render.schema_descriptions(db, F.lit("name means full name")))
    assert described[1] == (
        "table: student, column: name, sample value: Ann, Bo, external knowledge: name means full name"
    )
    assert described[7] == "table: room, column: size"


def test_render_selection(filled):
    used = F.array(
        F.struct(F.lit("room").alias("table_name"), F.array(F.lit("size")).alias("columns")),
        F.struct(F.lit("student").alias("table_name"),
                 F.array(F.lit("name"), F.lit("sid")).alias("columns")),
    )
    db = F.col("db_schema")
    assert one(filled, render.schema_text_by_columns(db, used)) == (
        "# student ( sid, name ( e.g., `Ann`, `Bo`, etc. ) )\n# room ( size )"
    )
    assert one(filled, render.schema_text_in_order(db, used)) == (
        "# room ( size )\n# student ( name ( e.g., `Ann`, `Bo`, etc. ), sid )"
    )
    assert one(filled, render.schema_text_by_columns(db, used, exact=True)).split("\n")[0] == (
        "# student ( sid (name ( e.g., `Ann`, `Bo`, etc"
    )
