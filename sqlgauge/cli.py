"""Command line: one subcommand per stage.

    python -m sqlgauge.cli <stage> [options]
"""

from __future__ import annotations

import argparse
import importlib
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.operators import dataset, scoring, training, values
from sqlgauge.operators.execute import Executor, evaluation_pairs
from sqlgauge.operators.generate import DEFAULT_RETRIES, correct_queries, draft_queries
from sqlgauge.plans.preprocess import prepare, with_prompt_text
from sqlgauge.session import get_session
from sqlgauge.sources import catalog, readers, writers
from sqlgauge.sources.databases import folder_databases, load_all
from sqlgauge.sources.sqlite import sqlite_catalog

log = logging.getLogger("sqlgauge")


def _generator(spec: str):
    """``package.module:factory`` of a text generator."""
    module, _, name = spec.partition(":")
    return getattr(importlib.import_module(module), name)()


def _done(spark: SparkSession, path: str) -> bool:
    """Whether a finished output lies at ``path``, on whatever file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def table_catalog(spark: SparkSession, args: argparse.Namespace) -> None:
    writers.write_json(sqlite_catalog(spark, args.database_path), args.table_path, "overwrite")


def preprocess(spark: SparkSession, args: argparse.Namespace) -> None:
    if _done(spark, args.output):
        log.info("skipping, %s exists", args.output)
        return
    tables = readers.read_tables_json(spark, args.table_path, lines=args.json_lines)
    descriptions = readers.read_descriptions(spark, args.db_path) if args.descriptions else None
    stored = values.store_values(
        values.column_values(load_all(spark, folder_databases(args.db_path)))
    )
    natsql = readers.read_natsql(spark, args.natsql_path) if args.natsql_path else None
    prepared = prepare(
        readers.read_questions(spark, args.dev_path, args.json_lines),
        catalog.resolve_schemas(tables, descriptions),
        stored,
        args.mode,
        args.target_type,
        natsql,
    )
    writers.write_parquet(prepared, args.output)


def _context(spark: SparkSession, args: argparse.Namespace, samples: bool = True) -> DataFrame:
    selected = (
        readers.read_selected_schema(spark, args.schema_path)
        if getattr(args, "schema_path", None)
        else None
    )
    return with_prompt_text(spark.read.parquet(args.preprocessed_path), selected, samples)


def generate(spark: SparkSession, args: argparse.Namespace) -> None:
    prepared = _context(spark, args)
    if _done(spark, args.output):
        prepared = dataset.remaining(prepared, spark.read.parquet(args.output))
    writers.write_parquet(draft_queries(prepared, _generator(args.generator)), args.output, "append")


def _executor(spark: SparkSession, args: argparse.Namespace) -> Executor:
    return Executor(spark, folder_databases(args.db_path), args.timeout, args.num_cpus)


def correct(spark: SparkSession, args: argparse.Namespace) -> None:
    corrected = correct_queries(
        spark.read.parquet(args.input),
        _context(spark, args, samples=False),
        _executor(spark, args),
        _generator(args.generator),
        args.retry_num,
    )
    writers.write_parquet(corrected, args.output, "overwrite")


def append(spark: SparkSession, args: argparse.Namespace) -> None:
    samples = readers.read_questions(spark, args.dev_path, args.json_lines)
    predictions = spark.read.parquet(args.input)
    writers.write_predictions(writers.merge_predictions(predictions, samples), args.output)


def slice_samples(spark: SparkSession, args: argparse.Namespace) -> None:
    samples = readers.read_questions(spark, args.dev_path, args.json_lines)
    if not args.full:
        samples = dataset.slice_first(samples, args.n)
    writers.write_json(samples, args.output, "overwrite")
    writers.write_ordered_lines(writers.gold_lines(samples), "line", args.gold_output)


def _pairs(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    samples = readers.read_questions(spark, args.dev_path, args.json_lines)
    predictions = readers.read_predictions(spark, args.predicted_path, lines=True)
    return evaluation_pairs(predictions, readers.read_gold(spark, args.gold_path)), samples


def evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    pairs, samples = _pairs(spark, args)
    results = _executor(spark, args).evaluate(pairs)
    writers.write_json(results.orderBy("sql_idx"), args.output, "overwrite")
    print(scoring.report(scoring.accuracy_by_difficulty(results, samples), "accuracy"))


def efficiency(spark: SparkSession, args: argparse.Namespace) -> None:
    pairs, samples = _pairs(spark, args)
    ratios = scoring.time_ratios(_executor(spark, args).time_pairs(pairs, args.iterations))
    print(scoring.report(scoring.efficiency_by_difficulty(ratios, samples), "ves"))


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    prepared = spark.read.parquet(args.preprocessed_path)
    drafts = spark.read.parquet(args.input)
    gold = prepared.select("sql_idx", "db_id", F.col("sql").alias("gold_sql"))
    executor = _executor(spark, args)
    shown = executor.check_all(drafts).select("sql_idx", F.col("message").alias("result"))
    scored = (
        with_prompt_text(prepared)
        .join(prepared.select("sql_idx", F.col("db_schema").alias("schema_items")), "sql_idx")
        .join(gold.drop("db_id"), "sql_idx")
        .join(drafts.select("sql_idx", "predicted_sql"), "sql_idx")
        .join(shown, "sql_idx")
        .join(executor.evaluate(evaluation_pairs(drafts, gold)), "sql_idx")
    )
    writers.write_json(training.training_pairs(scored), args.output, "overwrite")


def integrate(spark: SparkSession, args: argparse.Namespace) -> None:
    merged = dataset.concatenate(*[spark.read.json(p, multiLine=not args.json_lines) for p in args.inputs])
    writers.write_json(merged, args.output, "overwrite")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("sqlgauge")
    top.add_argument("--master", help="for local runs, e.g. local[4]")
    stages = top.add_subparsers(required=True)

    def stage(name: str, run, *options: str) -> argparse.ArgumentParser:
        sub = stages.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--json_lines", action="store_true")
        for option in options:
            sub.add_argument(f"--{option}", required=True)
        return sub

    def running(sub: argparse.ArgumentParser) -> argparse.ArgumentParser:
        sub.add_argument("--timeout", type=float, default=30.0)
        sub.add_argument("--num_cpus", type=int, default=4)
        return sub

    stage("catalog", table_catalog, "database_path", "table_path")
    sub = stage("preprocess", preprocess, "table_path", "dev_path", "db_path", "output")
    sub.add_argument("--mode", default="test", choices=("train", "eval", "test"))
    sub.add_argument("--target_type", default="sql", choices=("sql", "natsql"))
    sub.add_argument("--natsql_path")
    sub.add_argument("--descriptions", action="store_true")
    sub = stage("generate", generate, "preprocessed_path", "generator", "output")
    sub.add_argument("--schema_path")
    sub = running(stage("correct", correct, "preprocessed_path", "input", "db_path", "generator", "output"))
    sub.add_argument("--schema_path")
    sub.add_argument("--retry_num", type=int, default=DEFAULT_RETRIES)
    stage("append", append, "dev_path", "input", "output")
    sub = stage("slice", slice_samples, "dev_path", "output", "gold_output")
    which = sub.add_mutually_exclusive_group(required=True)
    which.add_argument("-n", type=int)
    which.add_argument("--full", action="store_true")
    running(stage("evaluate", evaluate, "dev_path", "predicted_path", "gold_path", "db_path", "output"))
    sub = running(stage("efficiency", efficiency, "dev_path", "predicted_path", "gold_path", "db_path"))
    sub.add_argument("--iterations", type=int, default=5)
    running(stage("train", train, "preprocessed_path", "input", "db_path", "output"))
    sub = stage("integrate", integrate, "output")
    sub.add_argument("inputs", nargs="+")
    return top


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(name)s %(message)s")
    args = parser().parse_args(argv)
    args.run(get_session("sqlgauge", master=args.master), args)


if __name__ == "__main__":
    main()
