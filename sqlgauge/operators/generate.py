"""Draft, reflect and correct queries with a pluggable text generator.

Prompts are columns; the generator is called from the tasks in Arrow batches,
so calls spread over the cluster with the partitions. Only running a query
needs the driver (see ``operators.execute``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlgauge.functions import prompts
from sqlgauge.functions.text import clean_correction, clean_draft
from sqlgauge.operators.execute import Executor
from sqlgauge.session import materialise

DEFAULT_RETRIES = 10
CALL_ATTEMPTS = 10


class Generator(Protocol):
    """Completes one prompt. Has to be picklable: it is called inside tasks."""

    def complete(self, prompt: str, long_context: bool, temperature: float = 0.0) -> str: ...


class LookupGenerator:
    """Deterministic stand-in for a model: the first rule whose key is in the prompt."""

    def __init__(self, rules: list[tuple[str, str]], default: str = "1") -> None:
        self.rules = rules
        self.default = default

    def complete(self, prompt: str, long_context: bool, temperature: float = 0.0) -> str:
        return next((reply for key, reply in self.rules if key in prompt), self.default)


def complete_column(
    df: DataFrame,
    generator: Generator,
    prompt: str,
    output: str,
    attempts: int = CALL_ATTEMPTS,
    fallback_temperature: float | None = None,
) -> DataFrame:
    """Add the reply to each row's prompt; NULL after ``attempts`` failures.

    An empty reply is a failure and is asked for again. With a fallback
    temperature one more call is made with it.
    """
    tries = [0.0] * attempts
    if fallback_temperature is not None:
        tries.append(fallback_temperature)
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.StringType())])

    def one(text: str, long_context: bool) -> str | None:
        for temperature in tries:
            try:
                reply = generator.complete(text, long_context, temperature)
            except Exception:  # a failed call is retried, then left to the caller as NULL
                continue
            if reply:
                return reply
        return None

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            routed = zip(frame[prompt], frame["_long"])
            frame[output] = [one(text, bool(is_long)) for text, is_long in routed]
            yield frame.drop(columns="_long")

    return df.withColumn("_long", prompts.is_long(F.col(prompt))).mapInPandas(batches, schema)


def draft_queries(
    prepared: DataFrame, generator: Generator, attempts: int = CALL_ATTEMPTS
) -> DataFrame:
    """(sql_idx, db_id, predicted_sql, n_prompt_tokens, n_reply_tokens).

    ``prepared`` has (sql_idx, db_id, question, evidence, schema_text, fk_text).
    """
    prompt = prompts.fill(
        prompts.DRAFT,
        question=F.col("question"),
        knowledge=F.col("evidence"),
        schema=F.col("schema_text"),
        foreign_keys=F.col("fk_text"),
    )
    asked = prepared.select("sql_idx", "db_id", prompt.alias("prompt"))
    replies = complete_column(asked, generator, "prompt", "reply", attempts)
    sql = clean_draft(F.concat(F.lit("SELECT  "), F.col("reply")))
    return replies.select(
        "sql_idx",
        "db_id",
        sql.alias("predicted_sql"),
        prompts.token_estimate(F.col("prompt")).alias("n_prompt_tokens"),
        prompts.token_estimate(sql).alias("n_reply_tokens"),
    )


def token_usage(drafts: DataFrame) -> DataFrame:
    """Total tokens sent and received."""
    return drafts.agg(
        F.sum("n_prompt_tokens").alias("input_tokens"),
        F.sum("n_reply_tokens").alias("output_tokens"),
    )


def correct_queries(
    drafts: DataFrame,
    prepared: DataFrame,
    executor: Executor,
    generator: Generator,
    retries: int = DEFAULT_RETRIES,
) -> DataFrame:
    """(sql_idx, db_id, predicted_sql, ok, attempts) after execute/reflect/correct rounds.

    Every round runs all still failing queries, asks for a reason and for a
    correction, and writes its state to the shared folder. Where the generator
    gives no reply, the draft is restored.
    """
    def message(outcome_label: str) -> object:
        return F.concat(
            F.lit(f"### {outcome_label}: "), F.col("predicted_sql"),
            F.lit("\n### Error message: "), F.col("message"),
        )

    checked = executor.check_all(drafts)
    state = materialise(
        drafts.select("sql_idx", "db_id", "predicted_sql", F.col("predicted_sql").alias("draft"))
        .join(checked, "sql_idx")
        .select(
            "sql_idx", "db_id", "draft", "predicted_sql", "ok",
            message("SQL").alias("info"),
            F.lit(0).alias("attempts"),
            F.lit(False).alias("given_up"),
        ),
        "rounds",
    )
    context = prepared.select("sql_idx", "question", "evidence", "schema_text", "fk_text")
    for _ in range(retries):
        open_rows = state.where(~F.col("ok") & ~F.col("given_up"))
        if open_rows.isEmpty():
            break
        asked = _ask(open_rows, context, generator, prompts.REFLECT, "reason")
        info = F.concat(F.col("info"), F.lit("\n### Error Reason: "), F.col("reason"))
        reasoned = asked.withColumn("info", F.coalesce(info, F.col("info")))
        replied = materialise(
            _ask(reasoned.drop("reason"), context, generator, prompts.CORRECT, "reply"), "replies"
        )
        fixed = replied.where(F.col("reply").isNotNull()).withColumn(
            "predicted_sql", clean_correction(F.concat(F.lit("SELECT "), F.col("reply")))
        )
        outcome = executor.check_all(fixed)
        advanced = (
            fixed.drop("ok", "reply")
            .join(outcome.drop("condition"), "sql_idx")
            .withColumn("info", F.concat(F.col("info"), F.lit("\n"), message("new SQL")))
            .withColumn("attempts", F.col("attempts") + 1)
            .drop("message")
        )
        given_up = (
            replied.where(F.col("reply").isNull())
            .drop("reply")
            .withColumn("predicted_sql", F.col("draft"))
            .withColumn("given_up", F.lit(True))
        )
        settled = state.where(F.col("ok") | F.col("given_up"))
        state = materialise(
            settled.unionByName(advanced).unionByName(given_up), "rounds"
        )
    return state.select("sql_idx", "db_id", "predicted_sql", "ok", "attempts")


def _ask(
    rows: DataFrame, context: DataFrame, generator: Generator, template: str, output: str
) -> DataFrame:
    prompt = prompts.fill(
        template,
        question=F.col("question"),
        knowledge=F.col("evidence"),
        schema=F.col("schema_text"),
        foreign_keys=F.col("fk_text"),
        previous_information=F.col("info"),
    )
    asked = rows.join(context, "sql_idx").select(*rows.columns, prompt.alias("_prompt"))
    return complete_column(asked, generator, "_prompt", output).drop("_prompt")


