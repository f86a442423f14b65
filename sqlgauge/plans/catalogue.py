"""All registered queries and, where SQL can express them, their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlgauge.functions import render
from sqlgauge.functions import text as tx
from sqlgauge.functions.difficulty import difficulty, operator_count, table_count
from sqlgauge.functions.similarity import lcs_ratio

from sqlgauge.operators import dataset, scoring, training, usage
from sqlgauge.operators import values as vl
from sqlgauge.operators.execute import Executor, parquet_tables
from sqlgauge.plans import derived as dv
from sqlgauge.plans import formats
from sqlgauge.plans.grammar import GRAMMAR, Tables
from sqlgauge.plans.preprocess import contents_by_sample, prepare, with_contents
from sqlgauge.session import widen
from sqlgauge.sources import catalog, writers

Query = Callable[[SparkSession, str], DataFrame]


def _lines(column) -> F.Column:
    """Nested result as text, so that both engines compare the same value."""
    return F.array_join(column, ",")


# --- value retrieval -------------------------------------------------------


def _stored_values(spark: SparkSession, sf: str) -> DataFrame:
    return vl.store_values(dv.shop_values(spark, sf))


def _clean_questions(spark: SparkSession, sf: str) -> DataFrame:
    log = dv.question_log(spark, sf)
    return log.withColumn("question", tx.clean_question(F.col("question")))


def question_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return _clean_questions(spark, sf).select("sql_idx", "question")


def picklist_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return dv.shop_values(spark, sf).select("table_name", "column_name", "value")


def picklist_first_k(spark: SparkSession, sf: str) -> DataFrame:
    """First three values of every column of every table."""
    return vl.picklists({dv.DB_ID: dv.shop(spark, sf)}, 3).select(
        "table_name", "column_name", F.array_join("first_values", "|").alias("first_values")
    )


def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    stored = _stored_values(spark, sf)
    scores = vl.bm25_texts(_clean_questions(spark, sf), stored)
    return scores.select(
        "sql_idx", "table_name", "column_name", "value", F.round("score", 6).alias("score")
    )


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for every benchmark passage."""
    questions = dv.read(spark, sf, "benchmark").select(
        F.col("item_id").alias("sql_idx"), F.lit("web").alias("db_id"), F.col("text").alias("question")
    )
    values = vl.column_values(
        {"web": {"documents": widen(dv.read(spark, sf, "documents").select("text"))}}
    )
    stored = vl.store_values(values)
    top = vl.with_text(vl.bm25_topk(questions, stored, 10), stored)
    return top.select(
        "sql_idx", F.col("rank").cast("long").alias("rank"), F.md5("value").alias("value_md5"), F.round("score", 6).alias("score")
    )


def fuzzy_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = vl.fuzzy_pairs(_clean_questions(spark, sf), _stored_values(spark, sf))
    return found.select(
        "sql_idx", "table_name", "column_name", "value", "match_text", "source_text",
        F.round("match_score", 6).alias("match_score"), "match_size",
    )


def value_link_top2(spark: SparkSession, sf: str) -> DataFrame:
    linked = vl.link_values(_clean_questions(spark, sf), _stored_values(spark, sf))
    return linked.select(
        "sql_idx", "table_name", "column_name", F.array_join("matches", "|").alias("matches")
    )


def lcs_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of every part name with its type and brand."""
    part = dv.read(spark, sf, "part")
    return part.select(
        "p_partkey",
        F.round(lcs_ratio(F.lower("p_name"), F.lower("p_type")), 6).alias("name_type"),
        F.round(lcs_ratio(F.col("p_name"), F.col("p_brand")), 6).alias("name_brand"),
    )


def _document_words(spark: SparkSession, sf: str) -> DataFrame:
    documents = dv.read(spark, sf, "documents")
    return documents.select("lang", F.explode(F.split(F.lower("text"), " ")).alias("word"))


def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    words = _document_words(spark, sf)
    return words.groupBy("lang").agg(
        F.count_if(tx.is_stopword(F.col("word"))).alias("n_stop"),
        F.count_if(tx.is_commonword(F.col("word"))).alias("n_common"),
        F.count_if(tx.is_common_db_term(F.col("word"))).alias("n_db_terms"),
        F.count(F.lit(1)).alias("n_words"),
    )


def number_filter(spark: SparkSession, sf: str) -> DataFrame:
    words = _document_words(spark, sf)
    return words.groupBy("lang").agg(
        F.count_if(tx.is_number(F.col("word"))).alias("n_numbers"),
        F.count_if(tx.is_negative_int(F.col("word"))).alias("n_negative"),
        F.count_if(tx.is_float(F.col("word"))).alias("n_floats"),
    )


# --- SQL text --------------------------------------------------------------


def sql_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = dv.query_log(spark, sf)
    tokens = tx.sql_tokens(tx.double_to_single(F.col("gold_sql")))
    return log.select("sql_idx", F.array_join(tokens, " ").alias("tokens"))


def normalized(spark: SparkSession, sf: str) -> DataFrame:
    log = dv.query_log(spark, sf, dv.HEAVY_TASK_BYTES)
    return log.select("sql_idx", "db_id", tx.normalize_sql(F.col("gold_sql")).alias("norm_sql"))


def normalize_sql(spark: SparkSession, sf: str) -> DataFrame:
    return normalized(spark, sf).drop("db_id")


def table_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """(sql_idx, alias, table_name) of every aliased table."""
    spaced = tx.lower_outside_quotes(tx.white_space_fix(F.col("gold_sql")))
    log = dv.query_log(spark, sf).select("sql_idx", spaced.alias("spaced"))
    return log.select("sql_idx", F.inline(tx.alias_pairs(F.col("spaced"))))


def sql_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    names = catalog.with_names(dv.shop_schemas(spark, sf)).select("db_id", "schema_names")
    log = usage.with_schema(normalized(spark, sf), names)
    skeleton = tx.sql_skeleton(F.col("norm_sql"), F.col("schema_names"))
    return log.select("sql_idx", skeleton.alias("skeleton"))


def schema_labels(spark: SparkSession, sf: str) -> DataFrame:
    log = usage.with_schema(normalized(spark, sf), dv.shop_schemas(spark, sf))
    tables, columns = usage.sql_labels(F.col("norm_sql"), F.col("schema_items"))
    digits = F.transform(columns, lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ""))
    return log.select(
        "sql_idx",
        F.array_join(F.transform(tables, lambda x: x.cast("string")), "").alias("table_labels"),
        F.array_join(digits, "/").alias("column_labels"),
    )


def clause_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Tables, aggregates, directions, limit and counts of every query."""
    log = normalized(spark, sf).select("sql_idx", tx.clause_profile(F.col("norm_sql")).alias("p"))
    listed = [_lines(F.col(f"p.{n}")).alias(n)
              for n in ("tables", "aggregates", "set_operators", "directions")]
    plain = ("limit", "is_distinct", "n_joins", "n_conditions", "n_subqueries")
    return log.select("sql_idx", *listed, *[F.col(f"p.{n}").alias(n) for n in plain])


def draft_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    """Replies as models give them after a prompt that ends in SELECT, cleaned.

    Fenced, fenced in lower case with split operators, or only the rest of the statement.
    """
    log = dv.query_log(spark, sf)
    sql = F.col("gold_sql")
    split = F.replace(sql, F.lit(">="), F.lit("> ="))
    reply = (
        F.when(F.col("sql_idx") % 3 == 0, F.concat(F.lit("```sql\n"), sql, F.lit("\n```")))
        .when(F.col("sql_idx") % 3 == 1, F.concat(F.lit("```\n"), F.regexp_replace(split, "(?i)^select", "select"), F.lit("```")))
        .otherwise(F.regexp_replace(sql, r"(?i)^select\s+", ""))
    )
    raw = F.concat(F.lit("SELECT  "), reply)
    return log.select(
        "sql_idx",
        tx.clean_draft(raw).alias("draft"),
        tx.clean_correction(raw).alias("correction"),
    )


# --- schema graph and rendering --------------------------------------------


def _logged(spark: SparkSession, sf: str) -> DataFrame:
    schemas = usage.with_paths(dv.shop_schemas(spark, sf))
    return usage.with_schema(dv.query_log(spark, sf, dv.HEAVY_TASK_BYTES), schemas)


def catalog_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Every column with its type, key flag and number of distinct values."""
    columns = catalog.catalog_columns(dv.shop_schemas(spark, sf))
    values = dv.shop_values(spark, sf)
    counts = values.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n_values"))
    return columns.join(counts, ["table_name", "column_name"]).select(
        "table_name", "column_name", "table_idx", "col_idx", "data_type", "is_pk", "n_values"
    )


def catalog_fks(spark: SparkSession, sf: str) -> DataFrame:
    """Every foreign key with the number of distinct values on both sides."""
    fks = catalog.catalog_fks(dv.shop_schemas(spark, sf))
    columns = {(t, c) for a, b, d, e in dv.FOREIGN_KEYS for t, c in ((a, b), (d, e))}
    values = dv.shop_values(spark, sf, columns)
    counts = values.groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: counts.select(
        F.col("table_name").alias(f"{s}_table"), F.col("column_name").alias(f"{s}_column"),
        F.col("n").alias(f"{s}_values"),
    )
    return (
        fks.join(side("src"), ["src_table", "src_column"])
        .join(side("dst"), ["dst_table", "dst_column"])
        .select("fk_idx", "src_table", "src_column", "src_values",
                "dst_table", "dst_column", "dst_values")
    )


def used_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Tables named by each query, with neighbours, and with connecting tables."""
    named = usage.named_tables(F.col("gold_sql"), F.col("schema_items"))
    return _logged(spark, sf).select(
        "sql_idx",
        _lines(F.array_sort(named)).alias("named"),
        _lines(usage.with_neighbors(named, F.col("fk"))).alias("neighbors"),
        _lines(usage.connected_tables(named, F.col("fk"), F.col("paths"))).alias("connected"),
    )


def fk_reachability(spark: SparkSession, sf: str) -> DataFrame:
    """How many queries reach each table from a table they name, per distance."""
    schemas = dv.shop_schemas(spark, sf)
    named = usage.named_tables(F.col("gold_sql"), F.col("schema_items"))
    sources = (
        usage.with_schema(dv.query_log(spark, sf), schemas)
        .select("db_id", F.explode(named).alias("src"))
        .groupBy("db_id", "src")
        .agg(F.count(F.lit(1)).alias("n_queries"))
    )
    return sources.join(usage.reachable_tables(schemas), ["db_id", "src"]).select(
        "src", "dst", "depth", "n_queries"
    )


def _columns_text(used) -> F.Column:
    return F.array_join(
        F.transform(
            used, lambda u: F.concat(u["table_name"], F.lit(":"), F.array_join(u["columns"], ","))
        ),
        ";",
    )


def used_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns per table by word, by mention, and by mention plus keys."""
    sql, items = F.col("gold_sql"), F.col("schema_items")
    return _logged(spark, sf).select(
        "sql_idx",
        _columns_text(usage.used_columns(sql, items)).alias("by_word"),
        _columns_text(usage.mentioned_columns(sql, items)).alias("by_mention"),
        _columns_text(usage.mentioned_columns_with_keys(sql, items, F.col("fk"))).alias("with_keys"),
    )


def _sampled_schema(spark: SparkSession, sf: str) -> DataFrame:
    """The schema with the first two values of every column as sample values."""
    entry = F.struct(F.concat_ws(".", "table_name", "column_name"), "first_values")
    contents = vl.picklists({dv.DB_ID: dv.shop(spark, sf)}, 2).groupBy("db_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("contents")
    )
    return dv.shop_schemas(spark, sf).join(contents, "db_id").withColumn(
        "db_schema", with_contents(F.col("schema_items"), F.col("contents"))
    )


def render_schema(spark: SparkSession, sf: str) -> DataFrame:
    schema = _sampled_schema(spark, sf)
    return schema.select(
        "db_id",
        render.schema_text(F.col("db_schema")).alias("schema_text"),
        render.schema_text(F.col("db_schema"), exact=True).alias("exact_text"),
        render.schema_text_simple(F.col("db_schema")).alias("simple_text"),
        F.array_join(render.schema_descriptions(F.col("db_schema")), "\n").alias("descriptions"),
        render.schema_list_text(F.col("db_schema")).alias("numbered"),
    )


def render_fks(spark: SparkSession, sf: str) -> DataFrame:
    """Foreign-key lines among the tables named by each query."""
    named = usage.named_tables(F.col("gold_sql"), F.col("schema_items"))
    return _logged(spark, sf).select(
        "sql_idx", render.foreign_keys_text(F.col("fk"), named).alias("fk_text")
    )


def render_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The used part of the schema of each query, with sample values."""
    logged = usage.with_schema(dv.query_log(spark, sf, dv.HEAVY_TASK_BYTES), _sampled_schema(spark, sf))
    used = usage.used_columns(F.col("gold_sql"), F.col("schema_items"))
    named = usage.named_tables(F.col("gold_sql"), F.col("schema_items"))
    rows = logged.select("sql_idx", "db_schema", used.alias("used"), named.alias("named"))
    return rows.select(
        "sql_idx",
        render.schema_text_by_columns(F.col("db_schema"), F.col("used")).alias("by_columns"),
        render.schema_text_in_order(F.col("db_schema"), F.reverse("used")).alias("in_order"),
        render.schema_text_by_tables(F.col("db_schema"), F.col("named")).alias("by_tables"),
    )


def keys_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """Primary-key and join columns per table, with the rows they identify."""
    schemas = dv.shop_schemas(spark, sf)
    pk = usage.primary_keys_by_table(schemas).select(
        "table_name", _lines(F.col("columns")).alias("pk_columns")
    )
    joins = usage.join_columns_by_table(
        catalog.catalog_columns(schemas), catalog.catalog_fks(schemas)
    ).select("table_name", _lines(F.col("columns")).alias("join_columns"))
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
        for t, df in dv.shop(spark, sf).items()
    ]
    rows = dataset.concatenate(*counts)
    return rows.join(joins, "table_name").join(pk, "table_name", "left").select(
        "table_name", "n_rows", "join_columns", "pk_columns"
    )


# --- evaluation ------------------------------------------------------------

# (gold, predicted): equal sets in another order or with repeats; other column
# order; other rows; all empty; NULL rows; whole numbers against fractions;
# text against numbers; other number of columns.
MATCH_PAIRS = [
    ("SELECT c_nationkey FROM customer", "SELECT DISTINCT c_nationkey FROM customer ORDER BY 1"),
    ("SELECT p_brand, p_type FROM part", "SELECT p_type, p_brand FROM part"),
    ("SELECT o_custkey FROM orders", "SELECT o_custkey FROM orders WHERE o_totalprice > 1000"),
    ("SELECT p_name FROM part WHERE p_size < 0", "SELECT p_name FROM part WHERE p_size > 10000"),
    (
        "SELECT nullif(o_orderstatus, 'F') AS s FROM orders",
        "SELECT CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS s FROM orders",
    ),
    ("SELECT p_size FROM part", "SELECT CAST(p_size AS DOUBLE) AS p_size FROM part"),
    (
        "SELECT o_orderkey, o_totalprice FROM orders",
        "SELECT o_orderkey, o_totalprice + 0 AS o_totalprice FROM orders",
    ),
    ("SELECT count(*) FROM lineitem", "SELECT count(*) FROM lineitem WHERE l_quantity >= 0"),
]


def _executor(spark: SparkSession, sf: str) -> Executor:
    return Executor(spark, {dv.DB_ID: parquet_tables(sf, dv.SHOP_TABLES)})


def exec_match(spark: SparkSession, sf: str) -> DataFrame:
    ex = _executor(spark, sf)
    return scoring.match_table(
        [
            (i, ex.query(dv.DB_ID, predicted), ex.query(dv.DB_ID, gold))
            for i, (gold, predicted) in enumerate(MATCH_PAIRS)
        ]
    )


# Predictions for the statement below, by supplier key: equal, repeats dropped, other rows, and
# statements that fail when analysed (two); every 40th fails when run.
SCORED_GOLD = "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = {k}"
SCORED_SHAPES = [
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = {k} ORDER BY l_quantity",
    "SELECT DISTINCT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = {k}",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = {k} AND l_quantity > 2",
    "SELECT l_orderkey, l_quantities FROM lineitem WHERE l_suppkey = {k}",
    "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = ",
]
SCORED_FAILURE = "SELECT l_orderkey, raise_error('stopped') FROM lineitem WHERE l_suppkey = {k}"


def _scored_pairs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    filled = lambda text: F.replace(F.lit(text), F.lit("{k}"), key.cast("string"))
    shapes = F.array(*[filled(s) for s in SCORED_SHAPES])
    return dv.read(spark, sf, "supplier").select(
        key.alias("sql_idx"),
        F.lit(dv.DB_ID).alias("db_id"),
        F.when(key % 40 == 5, filled(SCORED_FAILURE))
        .otherwise(F.get(shapes, (key % len(SCORED_SHAPES)).cast("int")))
        .alias("predicted_sql"),
        filled(SCORED_GOLD).alias("gold_sql"),
    )


def evaluate_log(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for one statement per supplier, run and scored in windows."""
    return _executor(spark, sf).evaluate(_scored_pairs(spark, sf))


def check_log(spark: SparkSession, sf: str) -> DataFrame:
    """The same predictions run on their own: their first three rows in order, or the error class."""
    drafts = _scored_pairs(spark, sf).select(
        "sql_idx",
        "db_id",
        F.concat(F.regexp_replace("predicted_sql", " ORDER BY .*", ""), F.lit(" ORDER BY 1, 2")).alias("predicted_sql"),
    )
    checked = _executor(spark, sf).check_all(drafts, 3)
    return checked.select("sql_idx", "ok", F.when(F.col("ok"), F.col("message")).alias("rows"), "condition")


def difficulty_class(spark: SparkSession, sf: str) -> DataFrame:
    sql = F.col("gold_sql")
    return dv.query_log(spark, sf).select(
        "sql_idx",
        operator_count(sql).cast("long").alias("n_operators"),
        table_count(sql).cast("long").alias("n_tables"),
        difficulty(sql).alias("difficulty"),
    )


def difficulty_counts(spark: SparkSession, sf: str) -> DataFrame:
    levels = scoring.with_difficulty(dv.query_log(spark, sf))
    return levels.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))


def acc_by_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    log = dv.query_log(spark, sf)
    scores = scoring.accuracy_by_difficulty(log.select("sql_idx", "res"), log.drop("res"))
    return scores.select("level", "count", F.round("accuracy", 6).alias("accuracy"))


def _timings(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as timing ratios of the users."""
    return dv.read(spark, sf, "events").select(
        F.col("user_id").alias("sql_idx"), F.col("value").alias("ratio")
    )


def outlier_trim(spark: SparkSession, sf: str) -> DataFrame:
    kept = scoring.clean_abnormal(_timings(spark, sf))
    return kept.groupBy("sql_idx").agg(
        F.count(F.lit(1)).alias("n_kept"), F.round(F.sum("ratio"), 4).alias("total")
    )


def ves_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    score = scoring.efficiency_score(scoring.time_ratios(_timings(spark, sf)))
    return score.select(F.round("ves", 6).alias("ves"))


def ves_by_difficulty(spark: SparkSession, sf: str) -> DataFrame:
    ratios = scoring.time_ratios(_timings(spark, sf))
    scores = scoring.efficiency_by_difficulty(ratios, dv.query_log(spark, sf))
    return scores.select("level", "count", F.round("ves", 6).alias("ves"))


# --- samples ---------------------------------------------------------------


def train_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Training pairs of the query log; every third gold query was answered wrongly."""
    wrong = F.concat("gold_sql", F.lit(" -- draft"))
    log = usage.with_schema(dv.query_log(spark, sf, dv.HEAVY_TASK_BYTES), dv.shop_schemas(spark, sf))
    scored = log.select(
        "sql_idx",
        F.concat(F.lit("Question "), "sql_idx").alias("question"),
        F.when(F.col("res") == 1, F.lit("known")).alias("evidence"),
        "schema_items",
        render.schema_text_simple(F.col("schema_items")).alias("schema_text"),
        render.foreign_keys_text(F.col("fk")).alias("fk_text"),
        wrong.alias("predicted_sql"),
        "gold_sql",
        F.concat(F.lit("["), F.col("res").cast("string"), F.lit("]")).alias("result"),
        "res",
    )
    pairs = training.training_pairs(scored)
    return pairs.select("sql_idx", F.md5("input").alias("input_md5"), "output")


def slice_first_n(spark: SparkSession, sf: str) -> DataFrame:
    """The slice operator with n = 500, and the size of each of seven chunks of the log."""
    log = dv.query_log(spark, sf)
    part = dataset.slice_first(log, 500)
    return part.select("sql_idx", "gold_sql")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of seven chunks of the log, whose size Spark counts."""
    log = dv.query_log(spark, sf)
    size = log.count()
    return dataset.with_chunk(log, size, 7).groupBy("chunk").agg(
        F.min("sql_idx").alias("first"), F.max("sql_idx").alias("last"),
        F.count(F.lit(1)).alias("n"),
    )


def resume_remaining(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of the log without a finished row."""
    log = dv.query_log(spark, sf)
    return dataset.remaining(log, log.where("res = 1")).select("sql_idx")


def merge_predictions(spark: SparkSession, sf: str) -> DataFrame:
    log = dv.query_log(spark, sf)
    joined = F.concat(F.lit("SELECT c_name || ', ' || c_mktsegment FROM ("), "gold_sql", F.lit(")"))
    predictions = log.select("sql_idx", joined.alias("predicted_sql"))
    return writers.merge_predictions(predictions, log)


def gold_lines(spark: SparkSession, sf: str) -> DataFrame:
    return writers.gold_lines(dv.query_log(spark, sf))


def prepared_samples(spark: SparkSession, sf: str) -> DataFrame:
    """All prepared fields of the question log, with nested fields as JSON."""
    samples = dv.question_log(spark, sf).join(
        dv.query_log(spark, sf).select("sql_idx", "gold_sql"), "sql_idx"
    )
    prepared = prepare(samples, dv.shop_schemas(spark, sf), _stored_values(spark, sf))
    nested = ("db_schema", "pk", "fk", "table_labels", "column_labels")
    return prepared.select(
        *[F.to_json(c).alias(c) if c in nested else c for c in prepared.columns]
    )


def sample_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Number of linked values per sample."""
    linked = vl.link_values(_clean_questions(spark, sf), _stored_values(spark, sf))
    contents = contents_by_sample(linked)
    n = F.aggregate(F.map_values("contents"), F.lit(0), lambda acc, v: acc + F.size(v))
    return contents.select("sql_idx", n.cast("long").alias("n_values"))


OPERATORS: dict[str, Query] = {
    "question_cleanup": question_cleanup,
    "picklist_distinct": picklist_distinct,
    "picklist_first_k": picklist_first_k,
    "bm25_scores": bm25_scores,
    "bm25_topk": bm25_topk,
    "fuzzy_matches": fuzzy_matches,
    "value_link_top2": value_link_top2,
    "lcs_ratio": lcs_ratios,
    "stopword_filter": stopword_filter,
    "number_filter": number_filter,
    "sql_tokens": sql_token_counts,
    "normalize_sql": normalize_sql,
    "table_aliases": table_aliases,
    "sql_skeleton": sql_skeleton,
    "schema_labels": schema_labels,
    "clause_profile": clause_profile,
    "draft_cleanup": draft_cleanup,
    "catalog_columns": catalog_columns,
    "catalog_fks": catalog_fks,
    "used_tables": used_tables,
    "fk_reachability": fk_reachability,
    "used_columns": used_columns,
    "render_schema": render_schema,
    "render_fks": render_fks,
    "render_selection": render_selection,
    "keys_by_table": keys_by_table,
    "exec_match": exec_match,
    "evaluate_log": evaluate_log,
    "check_log": check_log,
    "difficulty_class": difficulty_class,
    "difficulty_counts": difficulty_counts,
    "acc_by_difficulty": acc_by_difficulty,
    "outlier_trim": outlier_trim,
    "ves_aggregate": ves_aggregate,
    "ves_by_difficulty": ves_by_difficulty,
    "train_pairs": train_pairs,
    "slice_first_n": slice_first_n,
    "chunks": chunks,
    "resume_remaining": resume_remaining,
    "merge_predictions": merge_predictions,
    "gold_lines": gold_lines,
    "prepared_samples": prepared_samples,
    "sample_contents": sample_contents,
}

# Query texts that also run as text, through the executor's session.
TEXT_QUERIES = (
    "filter_and_or", "group_having", "join_three", "join_theta", "order_multi_dir",
    "set_chain", "sub_not_in", "sub_scalar", "sub_correlated",
)


def _grammar_query(name: str) -> Query:
    return lambda spark, sf: GRAMMAR[name][0](Tables(spark, sf))


def _text_query(name: str) -> Query:
    return lambda spark, sf: _executor(spark, sf).query(dv.DB_ID, GRAMMAR[name][1])


def queries() -> dict[str, Query]:
    found = {name: _grammar_query(name) for name in GRAMMAR}
    found.update({f"text_{name}": _text_query(name) for name in TEXT_QUERIES})
    found.update(OPERATORS)
    found.update(formats.QUERIES)
    return found


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy per difficulty of queries scored by running them."""
    results = exec_match(spark, sf)
    texts = spark.createDataFrame(
        [(i, gold) for i, (gold, _) in enumerate(MATCH_PAIRS)], "sql_idx long, gold_sql string"
    )
    return scoring.accuracy_by_difficulty(results, texts)


