"""Queries of the file formats: the query log written by a writer and read back by its reader.

The files lie in the shared folder and are written by Spark, one part per task, so every reader is
tried on many files and blocks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions import prompts
from sqlgauge.functions import text as tx
from sqlgauge.operators import usage
from sqlgauge.plans import derived as dv
from sqlgauge.session import shared_folder
from sqlgauge.sources import readers, writers


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(spark: SparkSession, df: DataFrame, line: Column, name: str) -> str:
    """Files of one line per row, in key order."""
    path = _place(spark, name)
    writers.write_ordered_lines(df.select("sql_idx", line.alias("line")), "line", path)
    return path


def gold_source(spark: SparkSession, sf: str) -> DataFrame:
    """Gold lines, numbered by their place, split at the last tab."""
    path = _place(spark, "gold")
    writers.write_ordered_lines(writers.gold_lines(dv.query_log(spark, sf)), "line", path)
    return readers.read_gold(spark, path)


def sql_source(spark: SparkSession, sf: str) -> DataFrame:
    """Plain statements, one per line."""
    log = dv.query_log(spark, sf)
    return readers.read_train_sql(spark, _lines(spark, log, F.concat(F.lit("  "), "gold_sql"), "drafts"))


def prediction_source(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of three statements of four; every fourth entry of the file is not a text."""
    log = dv.query_log(spark, sf)
    entries = writers.merge_predictions(log.select("sql_idx", F.col("gold_sql").alias("predicted_sql")), log)
    path = _place(spark, "predictions")
    number = F.concat(F.lit('{"'), "sql_idx", F.lit('": 0}'))
    text = F.to_json(F.create_map(F.col("sql_idx").cast("string"), F.col("entry")))
    line = F.when(F.col("sql_idx") % 4 == 3, number).otherwise(text)
    writers.write_ordered_lines(entries.select("sql_idx", line.alias("line")), "line", path)
    return readers.read_predictions(spark, path, lines=True)


def question_source(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as JSON lines without a key; statements under ``query`` or ``SQL`` by turns."""
    log = dv.question_log(spark, sf).join(dv.query_log(spark, sf).select("sql_idx", "gold_sql"), "sql_idx")
    odd = F.col("sql_idx") % 2 == 1
    fields = F.struct(
        "db_id", "question", "evidence",
        F.when(odd, F.col("gold_sql")).alias("query"), F.when(~odd, F.col("gold_sql")).alias("SQL"),
    )
    path = _lines(spark, log, F.to_json(fields), "questions")
    found = readers.read_questions(spark, path, lines=True)
    return found.withColumn("question", tx.clean_question(F.col("question")))


# A natural form of the query log: conditions on dotted columns, no joins
NATSQL = "select {table}.* from {table} where @.@ = {table}.{column} and {table}.{other} > {k}"
NATSQL_TABLES = [
    ("orders", "o_custkey", "o_totalprice"), ("customer", "c_name", "c_acctbal"), ("part", "p_brand", "p_size")
]


def natsql_source(spark: SparkSession, sf: str) -> DataFrame:
    """Natural SQL read back, in canonical form, with the labels of the tables and columns it names."""
    log = dv.query_log(spark, sf)
    texts = [
        NATSQL.replace("{table}", t).replace("{column}", c).replace("{other}", o) for t, c, o in NATSQL_TABLES
    ]
    text = F.get(F.array(*[F.lit(t) for t in texts]), (F.col("sql_idx") % len(texts)).cast("int"))
    text = F.replace(text, F.lit("{k}"), F.col("sql_idx").cast("string"))
    path = _lines(spark, log, F.to_json(F.struct(F.concat(F.lit(" "), text).alias("NatSQL"))), "natsql")
    rows = readers.read_natsql(spark, path, lines=True).withColumn("db_id", F.lit(dv.DB_ID))
    labelled = usage.with_schema(
        rows.select("sql_idx", "db_id", tx.normalize_sql(F.col("natsql")).alias("norm_natsql")),
        dv.shop_schemas(spark, sf),
    )
    tables, columns = usage.natsql_labels(F.col("norm_natsql"), F.col("schema_items"))
    digits = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "")
    return labelled.select(
        "sql_idx", "norm_natsql", digits(tables).alias("table_labels"),
        F.array_join(F.transform(columns, digits), "/").alias("column_labels"),
    )


def selection_source(spark: SparkSession, sf: str) -> DataFrame:
    """Selected parts of the schema: one map of tables to columns per line."""
    log = dv.query_log(spark, sf)
    chosen = F.create_map(
        F.lit("orders"), F.array(F.lit("o_orderkey"), F.concat(F.lit("o_"), F.col("sql_idx").cast("string"))),
        F.lit("part"), F.array(F.lit("p_name")),
    )
    found = readers.read_selected_schema(spark, _lines(spark, log, F.to_json(chosen), "selections"), lines=True)
    pair = lambda u: F.concat(u["table_name"], F.lit(":"), F.array_join(u["columns"], ","))
    return found.select("sql_idx", F.array_join(F.transform("used", pair), ";").alias("used"))


def example_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with a new question, its knowledge (every second one) and statement, taken apart."""
    log = dv.query_log(spark, sf)
    known = F.col("sql_idx") % 2 == 0
    knowledge = F.when(known, F.concat(F.lit("New External Knowledge: fact "), "sql_idx", F.lit("\n"))).otherwise(F.lit(""))
    reply = F.concat(
        F.lit("Sure.\nNew Question: what about "), "sql_idx", F.lit("?\n"), knowledge, F.lit("New Gold SQL: "), "gold_sql", F.lit("\n")
    )
    parsed = F.when(known, prompts.parse_new_example(reply, True)).otherwise(prompts.parse_new_example(reply, False))
    return log.select("sql_idx", parsed.alias("new")).select(
        "sql_idx", "new.question", F.col("new.knowledge").alias("evidence"), F.col("new.sql").alias("gold_sql")
    )


QUERIES = {
    "gold_source": gold_source,
    "sql_source": sql_source,
    "prediction_source": prediction_source,
    "question_source": question_source,
    "natsql_source": natsql_source,
    "selection_source": selection_source,
    "example_replies": example_replies,
}
