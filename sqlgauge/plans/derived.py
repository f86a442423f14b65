"""Inputs that Spark derives from the star-schema tables.

Questions and query texts are built from table rows, so they grow with the
tables. The databases of the registered queries are these tables themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.operators.values import column_values
from sqlgauge.session import widen
from sqlgauge.sources.catalog import schemas_of_tables

DB_ID = "shop"
SHOP_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
)
PRIMARY_KEYS = {
    "region": ["r_regionkey"],
    "nation": ["n_nationkey"],
    "customer": ["c_custkey"],
    "supplier": ["s_suppkey"],
    "part": ["p_partkey"],
    "orders": ["o_orderkey"],
}
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]

def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shop(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read(spark, folder, name) for name in SHOP_TABLES}


def shop_values(
    spark: SparkSession, folder: str, columns: set[tuple[str, str]] | None = None
) -> DataFrame:
    """Distinct values of all or the chosen columns of the shop."""
    tables = {}
    for name, df in shop(spark, folder).items():
        fields = [c for c in df.columns if columns is None or (name, c) in columns]
        if fields:
            tables[name] = widen(df.select(*fields))
    return column_values({DB_ID: tables}, columns)


def shop_schemas(spark: SparkSession, folder: str) -> DataFrame:
    return schemas_of_tables(
        spark, DB_ID, shop(spark, folder), PRIMARY_KEYS, FOREIGN_KEYS
    )


def question_log(spark: SparkSession, folder: str) -> DataFrame:
    """(sql_idx, db_id, question, evidence): one question per order, as in the query log.

    The part is that of the order's lines with the smallest key; an order may have none. Orders are few bytes
    for the work that each question makes, so a task gets a bounded share of their files.
    """
    orders, customer, nation, region, part, lineitem = (
        read(spark, folder, t)
        for t in ("orders", "customer", "nation", "region", "part", "lineitem")
    )
    first_part = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("first_part"))
    rows = (
        widen(orders.select("o_orderkey", "o_custkey"), HEAVY_TASK_BYTES)
        .join(first_part, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(part.select("p_partkey", "p_name", "p_brand"), F.col("p_partkey") == F.col("first_part"), "left")
        .join(customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
    )
    goods = F.concat("p_name", F.lit("s of ‘"), "p_brand", F.lit("’"))
    question = F.concat(
        F.lit(" Which "), F.coalesce(goods, F.lit("goods")), F.lit(" did "), "n_name",
        F.lit("’s buyers ("), F.lower("r_name"), F.lit(") order for the "), "c_mktsegment",
        F.lit(" market?"),
    )
    return rows.select(
        F.col("o_orderkey").alias("sql_idx"),
        F.lit(DB_ID).alias("db_id"),
        question.alias("question"),
        F.when(F.col("r_name") != "ASIA", F.concat("r_name", F.lit(" is a region"))).alias(
            "evidence"
        ),
    )


# One query text per order, in one of these shapes by order key.
QUERY_SHAPES = [
    'SELECT count(*) FROM orders WHERE o_orderpriority = "{prio}";',
    "SELECT T1.c_name ,  T2.o_totalprice FROM customer AS T1 JOIN orders AS T2 ON "
    "T1.c_custkey = T2.o_custkey WHERE T2.o_orderkey = {key}",
    "select o_orderstatus, avg(o_totalprice), max(o_totalprice) from orders where o_custkey = "
    "{cust} group by o_orderstatus having count(*) > 1 order by avg(o_totalprice)",
    "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100.5 AND {price} AND "
    "o_orderstatus != '{status}' OR o_custkey > {cust} ORDER BY o_totalprice DESC LIMIT 5",
    "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE "
    "o_orderkey < {key}) EXCEPT SELECT c_name FROM customer WHERE c_acctbal >= -1",
    "SELECT T3.n_name, count(*) FROM orders AS T1 JOIN customer AS T2 ON T1.o_custkey = "
    "T2.c_custkey JOIN nation AS T3 ON T2.c_nationkey = T3.n_nationkey WHERE T1.o_orderpriority "
    "= '{prio}' GROUP BY T3.n_name ORDER BY T3.n_name",
    "SELECT l_quantity * l_extendedprice FROM lineitem WHERE l_orderkey = {key} AND "
    "l_tax >= -1 AND l_discount < 0.25",
    "SELECT 1",
]
_SHAPE_FIELDS = {
    "prio": "o_orderpriority",
    "key": "o_orderkey",
    "cust": "o_custkey",
    "price": "o_totalprice",
    "status": "o_orderstatus",
}


def shaped(shapes: list[str]) -> F.Column:
    """The text of the shape that the order key selects."""
    text = None
    for i, shape in enumerate(shapes):
        filled = F.lit(shape)
        for name, column in _SHAPE_FIELDS.items():
            if "{" + name + "}" in shape:
                filled = F.replace(filled, F.lit("{" + name + "}"), F.col(column).cast("string"))
        is_shape = F.pmod(F.col("o_orderkey"), F.lit(len(shapes))) == i
        text = F.when(is_shape, filled) if text is None else text.when(is_shape, filled)
    return text


# Files per task where each query text takes long: some 200,000 orders
HEAVY_TASK_BYTES = 4 << 20


def query_log(spark: SparkSession, folder: str, task_bytes: int | None = None) -> DataFrame:
    """(sql_idx, db_id, gold_sql, difficulty, res): one query text per order.

    ``task_bytes`` bounds the share of the files that one task gets, for work that is heavy per text.
    """
    orders = read(spark, folder, "orders").select(*_SHAPE_FIELDS.values())
    return widen(orders, task_bytes).select(
        F.col("o_orderkey").alias("sql_idx"),
        F.lit(DB_ID).alias("db_id"),
        shaped(QUERY_SHAPES).alias("gold_sql"),
        F.lit(None).cast("string").alias("difficulty"),
        (F.col("o_orderstatus") == "F").cast("int").alias("res"),
    )


def shaped_sql(shapes: list[str]) -> str:
    """The same text as a DuckDB expression over ``orders``."""
    cases = []
    for i, shape in enumerate(shapes):
        text = "'" + shape.replace("'", "''") + "'"
        for name, column in _SHAPE_FIELDS.items():
            if "{" + name + "}" in shape:
                text = f"replace({text}, '{{{name}}}', CAST({column} AS VARCHAR))"
        cases.append(f"WHEN {i} THEN {text}")
    return f"CASE o_orderkey % {len(shapes)} {' '.join(cases)} END"


def question_log_sql() -> str:
    """The cleaned questions as a DuckDB query."""
    return """
        SELECT o_orderkey AS sql_idx,
               'Which ' || coalesce(p_name || 's of ''' || p_brand || '''', 'goods') || ' did '
               || n_name || '''s buyers (' || lower(r_name) || ') order for the '
               || c_mktsegment || ' market?' AS question,
               CASE WHEN r_name <> 'ASIA' THEN r_name || ' is a region' END AS evidence
        FROM orders
        LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS first_part FROM lineitem GROUP BY l_orderkey)
          ON l_orderkey = o_orderkey
        LEFT JOIN part ON p_partkey = first_part
        JOIN customer ON c_custkey = o_custkey
        JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    """
