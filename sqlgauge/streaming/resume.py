"""Generation that resumes by itself: new question files as a stream.

The stream's checkpoint remembers the finished files, and a repeated batch
overwrites its own folder, so that a run after a failure neither loses nor
repeats a sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

QUESTION_DDL = (
    "sql_idx bigint, db_id string, question string, evidence string, "
    "schema_text string, fk_text string"
)


def process_new_files(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    step: Callable[[DataFrame], DataFrame],
    schema: str = QUESTION_DDL,
    files_per_batch: int = 64,
) -> StreamingQuery:
    """Run ``step`` on every file of JSON Lines in ``source`` not handled before.

    Handles what is there and stops; results are below ``target/batch=<n>``.
    """
    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(source)
    )
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
