"""Input/output pairs from scored predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlgauge.functions import prompts
from sqlgauge.functions.text import let
from sqlgauge.operators.generate import Generator, complete_column
from sqlgauge.session import materialise

STAR_COLUMNS = 3
FALLBACK_TEMPERATURE = 0.5


def linked_columns(gold_sql: Column, schema_items: Column) -> Column:
    """Tables and columns whose names occur in the gold query.

    A mentioned table without a mentioned column counts with its first three
    columns if the query holds a ``*``; tables that link nothing are left out.
    """
    def links(text: Column) -> Column:
        linked = F.transform(schema_items, lambda t: link(t, text))
        return F.filter(linked, lambda u: F.size(u["columns"]) > 0)

    def link(t: Column, text: Column) -> Column:
        named = F.contains(text, t["table_name_original"])
        found = F.filter(t["column_names_original"], lambda c: F.contains(text, c))
        starred = F.slice(t["column_names_original"], 1, STAR_COLUMNS)
        none = F.array().cast("array<string>")
        columns = (
            F.when(named & (F.size(found) > 0), found)
            .when(named & F.contains(text, F.lit("*")), starred)
            .otherwise(none)
        )
        return F.struct(t["table_name_original"].alias("table_name"), columns.alias("columns"))

    return let(F.lower(gold_sql), links)


def training_pairs(scored: DataFrame) -> DataFrame:
    """(sql_idx, input, output).

    ``scored`` has (sql_idx, question, evidence, schema_items, schema_text,
    fk_text, predicted_sql, gold_sql, result, res). The output is the prediction
    where it was right, else the gold query; samples whose gold query links to
    nothing in the schema are dropped.
    """
    text = prompts.fill(
        prompts.TRAIN,
        question=F.col("question"),
        knowledge=F.col("evidence"),
        schema=F.col("schema_text"),
        foreign_keys=F.col("fk_text"),
        sql=F.col("predicted_sql"),
        result=F.col("result"),
    )
    linked = F.size(linked_columns(F.col("gold_sql"), F.col("schema_items"))) > 0
    return scored.where(linked).select(
        "sql_idx",
        text.alias("input"),
        F.when(F.col("res") == 1, F.col("predicted_sql"))
        .otherwise(F.col("gold_sql"))
        .alias("output"),
    )


def new_examples(scored: DataFrame, generator: Generator, rounds: int = 0) -> DataFrame:
    """(sql_idx, round, question, evidence, gold_sql): generated variants.

    Each round varies the example of the round before; off (0) by default. A
    failing call is repeated once at a higher temperature.
    """
    current = scored.select(
        "sql_idx", F.lit(0).alias("round"), "question", "evidence", "gold_sql",
        "schema_text", "fk_text",
    )
    found = current.where(F.lit(False))
    for number in range(1, rounds + 1):
        prompt = prompts.fill(
            prompts.NEW_EXAMPLE,
            question=F.col("question"),
            knowledge=F.col("evidence"),
            schema=F.col("schema_text"),
            foreign_keys=F.col("fk_text"),
            sql=F.col("gold_sql"),
        )
        asked = complete_column(
            current.withColumn("_prompt", prompt),
            generator,
            "_prompt",
            "_reply",
            attempts=1,
            fallback_temperature=FALLBACK_TEMPERATURE,
        )
        new = F.when(
            F.col("evidence").isNull(), prompts.parse_new_example(F.col("_reply"), False)
        ).otherwise(prompts.parse_new_example(F.col("_reply"), True))
        replied = asked.where(F.col("_reply").isNotNull()).withColumn("_new", new)
        current = materialise(
            replied.select(
                "sql_idx",
                F.lit(number).alias("round"),
                F.col("_new.question").alias("question"),
                F.col("_new.knowledge").alias("evidence"),
                F.col("_new.sql").alias("gold_sql"),
                "schema_text",
                "fk_text",
            ),
            "examples",
        )
        found = found.unionByName(current)
    return found.select("sql_idx", "round", "question", "evidence", "gold_sql")
