"""Database catalogs: from ``tables.json`` records or from Spark tables.

One row per database holds its whole schema as nested arrays, so that a sample
meets its schema in one equi-join on ``db_id``. A row grows with the number of
columns of a database, never with its data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_FIELDS = T.StructType(
    [
        T.StructField("table_name_original", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("column_names", T.ArrayType(T.StringType())),
        T.StructField("column_names_original", T.ArrayType(T.StringType())),
        T.StructField("column_types", T.ArrayType(T.StringType())),
        T.StructField("column_description", T.ArrayType(T.StringType())),
        T.StructField("value_description", T.ArrayType(T.StringType())),
    ]
)
PK_FIELDS = T.StructType(
    [
        T.StructField("table_name_original", T.StringType()),
        T.StructField("column_name_original", T.StringType()),
    ]
)
FK_FIELDS = T.StructType(
    [
        T.StructField("source_table_name_original", T.StringType()),
        T.StructField("source_column_name_original", T.StringType()),
        T.StructField("target_table_name_original", T.StringType()),
        T.StructField("target_column_name_original", T.StringType()),
    ]
)
SCHEMA_FIELDS = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("schema_items", T.ArrayType(TABLE_FIELDS)),
        T.StructField("pk", T.ArrayType(PK_FIELDS)),
        T.StructField("fk", T.ArrayType(FK_FIELDS)),
    ]
)

# Mixed JSON arrays ([0, "name"], and 3 or [3, 4]) are read as text and parsed below.
TABLES_JSON_FIELDS = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("table_names", T.ArrayType(T.StringType())),
        T.StructField("table_names_original", T.ArrayType(T.StringType())),
        T.StructField("column_names", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("column_names_original", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("column_types", T.ArrayType(T.StringType())),
        T.StructField("primary_keys", T.ArrayType(T.StringType())),
        T.StructField("foreign_keys", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


def resolve_schemas(tables: DataFrame, descriptions: DataFrame | None = None) -> DataFrame:
    """Resolve ``tables.json`` records into one nested schema row per database.

    Index lookups happen inside the row; only the column descriptions, long
    rows of (db_id, table_name, column_name, column_description,
    value_description), need a join.
    """
    records = tables
    if descriptions is not None:
        texts = descriptions.groupBy("db_id").agg(
            F.map_from_entries(
                F.collect_list(
                    F.struct(
                        F.concat_ws(".", F.lower("table_name"), F.lower("column_name")),
                        F.struct("column_description", "value_description"),
                    )
                )
            ).alias("texts")
        )
        records = records.join(texts, "db_id", "left")
    else:
        empty = "map<string,struct<column_description:string,value_description:string>>"
        records = records.withColumn("texts", F.lit(None).cast(empty))

    originals = F.col("column_names_original")
    table_originals = F.col("table_names_original")

    def table_of(column: Column) -> Column:
        return F.lower(F.get(table_originals, column[0].cast("int")))

    def endpoint(index: Column) -> Column:
        return F.get(originals, index)

    columns = F.transform(
        originals,
        lambda c, i: F.struct(
            c[0].cast("int").alias("table_idx"),
            F.lower(c[1]).alias("original"),
            F.lower(F.get(F.col("column_names"), i)[1]).alias("readable"),
            F.get(F.col("column_types"), i).alias("data_type"),
        ),
    )

    def description(table: Column, column: Column, field: str) -> Column:
        entry = F.try_element_at(F.col("texts"), F.concat_ws(".", F.lower(table), column))
        return F.coalesce(entry[field], F.lit(""))

    def table_item(table: Column, index: Column) -> Column:
        own = F.filter(F.col("columns"), lambda c: c["table_idx"] == index)
        return F.struct(
            F.lower(table).alias("table_name_original"),
            F.lower(F.get(F.col("table_names"), index)).alias("table_name"),
            F.transform(own, lambda c: c["readable"]).alias("column_names"),
            F.transform(own, lambda c: c["original"]).alias("column_names_original"),
            F.transform(own, lambda c: c["data_type"]).alias("column_types"),
            F.transform(
                own, lambda c: description(table, c["original"], "column_description")
            ).alias("column_description"),
            F.transform(
                own, lambda c: description(table, c["original"], "value_description")
            ).alias("value_description"),
        )

    # "3" and "[3,4]" both yield their integers: a composite key gives several entries.
    key_columns = F.transform(
        F.flatten(
            F.transform(
                F.col("primary_keys"), lambda k: F.regexp_extract_all(k, F.lit(r"\d+"), F.lit(0))
            )
        ),
        lambda i: endpoint(i.cast("int")),
    )
    return records.withColumn("columns", columns).select(
        "db_id",
        F.transform(table_originals, table_item).alias("schema_items"),
        F.transform(
            key_columns,
            lambda c: F.struct(
                table_of(c).alias("table_name_original"),
                F.lower(c[1]).alias("column_name_original"),
            ),
        ).alias("pk"),
        F.transform(
            F.col("foreign_keys"),
            lambda k: F.struct(
                table_of(endpoint(k[0])).alias("source_table_name_original"),
                F.lower(endpoint(k[0])[1]).alias("source_column_name_original"),
                table_of(endpoint(k[1])).alias("target_table_name_original"),
                F.lower(endpoint(k[1])[1]).alias("target_column_name_original"),
            ),
        ).alias("fk"),
    )


def table_record(
    db_id: str,
    tables: dict[str, DataFrame],
    primary_keys: dict[str, list[str]] | None = None,
    foreign_keys: list[tuple[str, str, str, str]] | None = None,
) -> dict:
    """The ``tables.json`` record of a set of Spark tables.

    Only schemas are looked at. Spark has no key metadata for plain tables, so
    the keys are declared; a foreign key is (table, column, table, column).
    """
    columns: list[list] = [[-1, "*"]]
    types = ["text"]
    position: dict[tuple[str, str], int] = {}
    for index, (name, df) in enumerate(tables.items()):
        for field, data_type in df.dtypes:
            position[(name, field)] = len(columns)
            columns.append([index, field])
            types.append(data_type)
    keys: list = []
    for name, fields in (primary_keys or {}).items():
        found = [position[(name, field)] for field in fields]
        keys.append(found[0] if len(found) == 1 else found)
    return {
        "db_id": db_id,
        "table_names": list(tables),
        "table_names_original": list(tables),
        "column_names": columns,
        "column_names_original": columns,
        "column_types": types,
        "primary_keys": keys,
        "foreign_keys": [
            [position[(t1, c1)], position[(t2, c2)]] for t1, c1, t2, c2 in foreign_keys or []
        ],
    }


def records_frame(spark: SparkSession, records: list[dict]) -> DataFrame:
    """Catalog records (metadata only) as a frame of ``tables.json`` shape."""
    rows = [
        (
            r["db_id"],
            r["table_names"],
            r["table_names_original"],
            [[str(x) for x in c] for c in r["column_names"]],
            [[str(x) for x in c] for c in r["column_names_original"]],
            r["column_types"],
            [str(k) for k in r["primary_keys"]],
            r["foreign_keys"],
        )
        for r in records
    ]
    return spark.createDataFrame(rows, TABLES_JSON_FIELDS)


def schemas_of_tables(
    spark: SparkSession,
    db_id: str,
    tables: dict[str, DataFrame],
    primary_keys: dict[str, list[str]] | None = None,
    foreign_keys: list[tuple[str, str, str, str]] | None = None,
) -> DataFrame:
    """Nested schema row of one database made of Spark tables."""
    record = table_record(db_id, tables, primary_keys, foreign_keys)
    return resolve_schemas(records_frame(spark, [record]))


def catalog_columns(schemas: DataFrame) -> DataFrame:
    """Long form: one row per column of every database."""
    tables = schemas.select("db_id", "pk", F.posexplode("schema_items").alias("table_idx", "t"))
    key = lambda name: F.struct(
        F.col("t.table_name_original").alias("table_name_original"),
        name.alias("column_name_original"),
    )
    return tables.select(
        "db_id",
        "table_idx",
        F.col("t.table_name_original").alias("table_name"),
        "pk",
        "t",
        F.posexplode("t.column_names_original").alias("col_idx", "column_name"),
    ).select(
        "db_id",
        "table_idx",
        "table_name",
        "col_idx",
        "column_name",
        F.get(F.col("t.column_types"), F.col("col_idx")).alias("data_type"),
        F.array_contains("pk", key(F.col("column_name"))).alias("is_pk"),
    )


def catalog_fks(schemas: DataFrame) -> DataFrame:
    """Long form: one row per foreign key of every database."""
    return schemas.select("db_id", F.posexplode("fk").alias("fk_idx", "k")).select(
        "db_id",
        "fk_idx",
        F.col("k.source_table_name_original").alias("src_table"),
        F.col("k.source_column_name_original").alias("src_column"),
        F.col("k.target_table_name_original").alias("dst_table"),
        F.col("k.target_column_name_original").alias("dst_column"),
    )


def schema_names(schema_items: Column) -> Column:
    """Every name a query may use: tables, columns, ``table.column``, ``*``."""
    def names(t: Column) -> Column:
        columns = F.concat(F.array(F.lit("*")), t["column_names_original"])
        return F.concat(
            F.array(t["table_name_original"]),
            columns,
            F.transform(columns, lambda c: F.concat(t["table_name_original"], F.lit("."), c)),
        )

    return F.array_distinct(F.flatten(F.transform(schema_items, names)))


def with_names(schemas: DataFrame) -> DataFrame:
    """Add ``schema_names``, made once per database and not once per sample."""
    return schemas.withColumn("schema_names", schema_names(F.col("schema_items")))


def name_ids(schema_items: Column) -> Column:
    """``array<struct<name, id>>``: the unique identifier of every schema name."""
    def ids(t: Column) -> Column:
        table = t["table_name_original"]
        dotted = F.transform(
            t["column_names_original"], lambda c: F.concat(table, F.lit("."), c)
        )
        return F.concat(dotted, F.array(table))

    names = F.flatten(F.transform(schema_items, ids))
    marked = F.transform(
        names, lambda n: F.struct(n.alias("name"), F.concat(F.lit("__"), n, F.lit("__")).alias("id"))
    )
    star = F.array(F.struct(F.lit("*").alias("name"), F.lit("__all__").alias("id")))
    return F.concat(star, marked)
