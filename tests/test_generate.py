"""Drafting, correcting, training pairs, sample sets, sources and the stream."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from sqlgauge import cli
from sqlgauge.operators import dataset, training
from sqlgauge.operators.execute import Executor, parquet_tables
from sqlgauge.operators.generate import LookupGenerator, correct_queries, draft_queries, token_usage
from sqlgauge.sources import catalog, readers, writers
from sqlgauge.sources.sqlite import read_sqlite, sqlite_catalog
from sqlgauge.streaming.resume import process_new_files

FOLDER = "/root/testdata/sf0.001"
CONTEXT = "sql_idx long, db_id string, question string, evidence string, schema_text string, fk_text string"


@pytest.fixture(scope="module")
def context(spark):
    return spark.createDataFrame(
        [
            (0, "shop", "how many orders", None, "# orders", ""),
            (1, "shop", "which parts", "parts have names", "# part", ""),
            (2, "shop", "unanswerable", None, "# none", ""),
        ],
        CONTEXT,
    )


class Silent:
    """Fails on what it does not know; first tries come back empty."""

    def __init__(self):
        self.seen = set()

    def complete(self, prompt, long_context, temperature=0.0):
        if "unanswerable" in prompt:
            raise RuntimeError("no answer")
        if prompt not in self.seen:
            self.seen.add(prompt)
            return ""
        return "count(*) FROM orders"


def test_drafts(spark, context):
    model = LookupGenerator([("how many", "```sql\nSELECT count(*)\nFROM orders```"), ("which", "p_name FROM part")])
    got = draft_queries(context, model)
    assert {r.sql_idx: r.predicted_sql for r in got.collect()} == {
        0: "SELECT count(*) FROM orders", 1: "SELECT p_name FROM part", 2: "SELECT 1"
    }
    usage = token_usage(got).first()
    assert usage.input_tokens > usage.output_tokens > 0
    retried = {r.sql_idx: r.predicted_sql for r in draft_queries(context, Silent(), attempts=2).collect()}
    assert retried == {0: "SELECT count(*) FROM orders", 1: "SELECT count(*) FROM orders", 2: None}


def test_correction_loop(spark, context):
    executor = Executor(spark, {"shop": parquet_tables(FOLDER, ["orders", "part"])})
    drafts = spark.createDataFrame(
        [(0, "shop", "SELECT coun(*) FROM orders"), (1, "shop", "SELECT p_name FROM part"),
         (2, "shop", "SELECT broken FROM nowhere")],
        "sql_idx long, db_id string, predicted_sql string",
    )
    # The right query comes only once the reason for the first error is in the prompt,
    # which works without evidence as well.
    model = LookupGenerator([
        ("unanswerable\n### SQL: SELECT broken FROM nowhere", "still_broken FROM nowhere"),
        ("### Error Reason: misspelt function", "count(*) FROM orders"),
        ("### Error Reason:", "misspelt function"),
    ])
    got = {r.sql_idx: r for r in correct_queries(drafts, context, executor, model, retries=2).collect()}
    assert (got[0].predicted_sql, got[0].ok, got[0].attempts) == ("SELECT count(*) FROM orders", True, 1)
    assert (got[1].predicted_sql, got[1].attempts) == ("SELECT p_name FROM part", 0)
    assert (got[2].ok, got[2].attempts) == (False, 2)


def test_correction_without_reply_restores_the_draft(spark, context):
    executor = Executor(spark, {"shop": parquet_tables(FOLDER, ["orders"])})
    drafts = spark.createDataFrame([(2, "shop", "SELECT broken FROM nowhere")],
                                   "sql_idx long, db_id string, predicted_sql string")
    row = correct_queries(drafts, context, executor, Silent(), retries=3).first()
    assert (row.predicted_sql, row.ok) == ("SELECT broken FROM nowhere", False)


def test_training(spark):
    record = {
        "db_id": "d", "table_names": ["t"], "table_names_original": ["t"],
        "column_names": [[-1, "*"], [0, "a"], [0, "bb"], [0, "cc"], [0, "dd"]],
        "column_names_original": [[-1, "*"], [0, "aa"], [0, "bb"], [0, "cc"], [0, "dd"]],
        "column_types": ["text"] * 5, "primary_keys": [], "foreign_keys": [],
    }
    schema = catalog.resolve_schemas(catalog.records_frame(spark, [record]))
    scored = schema.crossJoin(spark.createDataFrame(
        [(0, "q", None, "SELECT aa FROM t", "SELECT aa FROM t -- p", 1),
         (1, "q", "k", "SELECT bb FROM t", "SELECT cc FROM t", 0),
         (2, "q", None, "SELECT 1", "SELECT 1", 1),
         (3, "q", None, "SELECT * FROM t", "SELECT 1", 0)],
        "sql_idx long, question string, evidence string, gold_sql string, predicted_sql string, res int",
    )).select("*", F.lit("# t").alias("schema_text"), F.lit("").alias("fk_text"), F.lit("[]").alias("result"))
    got = {r.sql_idx: r for r in training.training_pairs(scored).collect()}
    assert set(got) == {0, 1, 3}
    assert got[0].output == "SELECT aa FROM t -- p" and got[1].output == "SELECT bb FROM t"
    assert "knowledge: k" in got[1].input and "knowledge" not in got[0].input
    star = scored.where("sql_idx = 3").select(
        training.linked_columns(F.col("gold_sql"), F.col("schema_items")).alias("u")
    ).first().u
    assert star[0]["columns"] == ["aa", "bb", "cc"]
    model = LookupGenerator([("Gold SQL", "New Question: n\nNew Gold SQL: SELECT 2")])
    base = scored.where("sql_idx = 0")
    assert training.new_examples(base, model).count() == 0
    more = training.new_examples(base, model, rounds=2).collect()
    assert [(r.round, r.question, r.gold_sql) for r in more] == [(1, "n", "SELECT 2"), (2, "n", "SELECT 2")]


def test_sample_sets(spark):
    samples = spark.range(23).select(F.col("id").alias("sql_idx"))
    assert dataset.slice_first(samples, 5).count() == 5 and dataset.slice_first(samples, 99).count() == 23
    with pytest.raises(ValueError):
        dataset.slice_first(samples, 0)
    chunked = {r.sql_idx: r.chunk for r in dataset.with_chunk(samples, 23, 7).collect()}
    assert chunked == {x: i for i in range(7) for x in range(i * 23 // 7, (i + 1) * 23 // 7)}
    done = samples.where("sql_idx % 2 = 0")
    assert dataset.remaining(samples, done).count() == 11
    merged = dataset.merge_in_order(done, dataset.remaining(samples, done)).collect()
    assert [r.sql_idx for r in merged] == list(range(23))


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_line_index_over_many_files_and_blocks(spark, tmp_path):
    for f in range(3):
        write(tmp_path / "lines" / f"part-{f}.txt", "".join(f"{f}-{i}\n" for i in range(50 + f)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        rows = readers.read_lines(spark, str(tmp_path / "lines"), "x").orderBy("sql_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.x for r in rows] == [f"{f}-{i}" for f in range(3) for i in range(50 + f)]
    assert [r.sql_idx for r in rows] == list(range(153))


def test_lines_are_numbered_where_they_lie(spark, tmp_path):
    for f in range(4):
        write(tmp_path / "lines" / f"part-{f}.txt", "".join(f"{f}-{i}\n" for i in range(9)))
    numbered = readers.read_lines(spark, str(tmp_path / "lines"), "x")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    # what is exchanged are blocks; lines are only scanned and projected
    assert not any("value#" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line or "Sort [" in line)
    assert "Window" in plan and "Exchange SinglePartition" in plan
    assert [r.x for r in numbered.where("x like '%-8'").orderBy("sql_idx").collect()] == [f"{f}-8" for f in range(4)]


def test_readers(spark, tmp_path):
    questions = [{"question": "a", "db_id": "x", "query": "SELECT 1"},
                 {"question": "b", "db_id": "y", "SQL": "SELECT 2", "evidence": "e", "difficulty": "simple"}]
    path = write(tmp_path / "dev.json", json.dumps(questions, indent=1))
    want = [(0, "x", "a", None, None, "SELECT 1"), (1, "y", "b", "e", "simple", "SELECT 2")]
    columns = ["sql_idx", "db_id", "question", "evidence", "difficulty", "gold_sql"]
    got = readers.read_questions(spark, path).select(columns).orderBy("sql_idx").collect()
    assert [tuple(r) for r in got] == want
    lines = write(tmp_path / "dev.jsonl", "\n".join(json.dumps(q) for q in questions))
    got = readers.read_questions(spark, lines, lines=True).select(columns).orderBy("sql_idx").collect()
    assert [tuple(r) for r in got] == want

    gold = write(tmp_path / "gold.sql", "SELECT\t1\tx\nSELECT 2\ty\n")
    assert [tuple(r) for r in readers.read_gold(spark, gold).orderBy("sql_idx").collect()] == [
        (0, "SELECT\t1", "x"), (1, "SELECT 2", "y")
    ]
    assert readers.read_train_sql(spark, gold, "gt").count() == 2
    assert readers.read_train_sql(spark, gold).columns == ["sql_idx", "predicted_sql"]
    pred = write(tmp_path / "p.json", json.dumps({"0": "SELECT 1\t----- bird -----\tx", "1": 0}))
    assert [tuple(r) for r in readers.read_predictions(spark, pred).orderBy("sql_idx").collect()] == [
        (0, "SELECT 1", "x"), (1, " ", "financial")
    ]
    natsql = write(tmp_path / "n.json", json.dumps([{"NatSQL": " select a "}]))
    assert [tuple(r) for r in readers.read_natsql(spark, natsql).collect()] == [(0, "select a")]
    short = write(tmp_path / "s.json", json.dumps([{"table": "T", "col_data": [{"column_name": "A"}]}]))
    assert [(r.table_name, r.column_names) for r in readers.read_column_schema(spark, short).collect()] == [("t", ["a"])]
    chosen = write(tmp_path / "c.json", json.dumps([{"t": ["a"]}]))
    used = readers.read_selected_schema(spark, chosen).first()
    assert used.sql_idx == 0 and used.used[0].table_name == "t" and used.used[0]["columns"] == ["a"]


def test_catalog_files(spark, tmp_path):
    record = {"db_id": "db", "table_names": ["T one"], "table_names_original": ["T"],
              "column_names": [[-1, "*"], [0, "A b"], [0, "C"]],
              "column_names_original": [[-1, "*"], [0, "AB"], [0, "C"]],
              "column_types": ["text", "int", "text"], "primary_keys": [[1, 2]], "foreign_keys": []}
    path = write(tmp_path / "tables.json", json.dumps([record], indent=1))
    csv = "original_column_name,column_name,column_description\nAB,café,\"two\nlines\"\n"
    write(tmp_path / "dbs" / "db" / "database_description" / "T.csv", csv, "latin-1")
    schemas = catalog.resolve_schemas(
        readers.read_tables_json(spark, path), readers.read_descriptions(spark, str(tmp_path / "dbs"))
    )
    table = schemas.first().schema_items[0]
    assert table.table_name == "t one" and table.column_types == ["int", "text"]
    assert table.column_description == ["two\tlines", ""] and table.value_description == ["café", ""]
    assert len(schemas.first().pk) == 2


def test_writers(spark, tmp_path):
    samples = spark.createDataFrame([(1, "d", "SELECT 2"), (0, "d", None), (2, None, "x"), (3, "e", "SELECT 4")],
                                    "sql_idx long, db_id string, gold_sql string")
    lines = writers.gold_lines(samples)
    assert sorted(r.line for r in lines.collect()) == ["SELECT 2\td", "SELECT 4\te"]
    writers.write_ordered_lines(lines, "line", str(tmp_path / "gold"))
    assert readers.read_gold(spark, str(tmp_path / "gold")).count() == 2
    entries = writers.merge_predictions(
        spark.createDataFrame([(3, "SELECT a || ' ' || b"), (1, "SELECT 2")], "sql_idx long, predicted_sql string"),
        samples,
    )
    writers.write_predictions(entries, str(tmp_path / "pred"))
    back = readers.read_predictions(spark, str(tmp_path / "pred"), lines=True).orderBy("sql_idx").collect()
    assert [tuple(r) for r in back] == [(1, "SELECT 2", "d"), (3, "SELECT a ,  b", "e")]


@pytest.fixture(scope="module")
def sqlite_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("dbs")
    os.makedirs(root / "zoo")
    con = sqlite3.connect(root / "zoo" / "zoo.sqlite")
    con.executescript("""
        CREATE TABLE Keeper (Id INTEGER PRIMARY KEY, Name TEXT);
        CREATE TABLE Animal (Id INTEGER PRIMARY KEY, Name TEXT, Weight REAL, Keeper INTEGER,
                             FOREIGN KEY (Keeper) REFERENCES Keeper (Id));
        CREATE TABLE Shift (Day TEXT, Keeper INTEGER REFERENCES Keeper, PRIMARY KEY (Day, Keeper));
    """)
    con.executemany("INSERT INTO Keeper VALUES (?, ?)", [(1, "Ann"), (2, "Bo")])
    con.executemany("INSERT INTO Animal VALUES (?, ?, ?, ?)",
                    [(i, f"animal {i % 4}", i / 2, 1 + i % 2) for i in range(1, 41)])
    con.execute("INSERT INTO Animal VALUES (100, CAST(x'e9e8' AS TEXT), 'heavy', NULL)")
    con.commit()
    con.close()
    return root


def test_sqlite(spark, sqlite_root):
    path = str(sqlite_root / "zoo" / "zoo.sqlite")
    animals = read_sqlite(spark, path, "Animal", partitions=4)
    assert animals.rdd.getNumPartitions() == 4
    weight = F.sum(F.expr("try_cast(Weight AS DOUBLE)"))
    assert animals.count() == 41 and animals.select(weight).first()[0] == 410.0
    odd = animals.where("Id = 100").first()
    assert odd.Name == "éè" and odd.Weight == "heavy"  # text in a REAL column is kept
    schemas = catalog.resolve_schemas(sqlite_catalog(spark, str(sqlite_root)))
    row = schemas.first()
    assert row.db_id == "zoo"
    assert [tuple(k) for k in row.fk] == [("animal", "keeper", "keeper", "id"), ("shift", "keeper", "keeper", "id")]
    assert ("shift", "keeper") in [tuple(k) for k in row.pk]


def test_sqlite_types_hold_every_cell(spark, tmp_path):
    path = str(tmp_path / "t.sqlite")
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE p (price DECIMAL(10,2), ok BOOLEAN, n INT, mixed INT, day DATE, free, code VARCHAR(9), none NUMERIC);
        INSERT INTO p VALUES (9.5, 1, 3.7, 1, '2024-01-02', 5, 7, NULL);
        INSERT INTO p VALUES (10, 0, 4, 'many', NULL, 6, 'x', NULL);
        INSERT INTO p VALUES (100.25, NULL, NULL, 3, NULL, NULL, NULL, NULL);
    """)
    con.close()
    rows = read_sqlite(spark, path, "p")
    assert [f.dataType.simpleString() for f in rows.schema.fields] == [
        "double", "bigint", "double", "string", "string", "bigint", "string", "double"
    ]
    assert [r.price for r in rows.orderBy("price").collect()] == [9.5, 10.0, 100.25]
    assert {r.n for r in rows.collect()} == {3.7, 4.0, None}
    assert {r.mixed for r in rows.collect()} == {"1", "many", "3"}


def test_command_line(spark, sqlite_root, tmp_path, capsys):
    dev = [{"question": "How heavy is animal 3?", "db_id": "zoo", "evidence": "weight",
            "query": "SELECT Weight FROM Animal WHERE Name = 'animal 3'"},
           {"question": "Which keeper is Ann?", "db_id": "zoo", "query": "SELECT Id FROM Keeper"}]
    path = write(tmp_path / "dev.json", json.dumps(dev))
    out = lambda name: str(tmp_path / name)
    root = str(sqlite_root)
    cli.main(["catalog", "--database_path", root, "--table_path", out("tables")])
    cli.main(["preprocess", "--table_path", out("tables"), "--json_lines", "--mode", "train",
              "--dev_path", write(tmp_path / "dev.jsonl", "\n".join(json.dumps(d) for d in dev)),
              "--db_path", root, "--output", out("prepared")])
    prepared = {r.sql_idx: r for r in spark.read.parquet(out("prepared")).collect()}
    assert prepared[0].norm_sql == "select weight from animal where name = 'animal 3'"
    assert prepared[0].sql_skeleton == "select _ from _ where _"
    tables = [t.table_name_original for t in prepared[0].db_schema]
    animal = prepared[0].db_schema[tables.index("animal")]
    assert animal.db_contents[animal.column_names_original.index("name")][0] == "animal 3"
    assert prepared[0].table_labels == [int(t == "animal") for t in tables]
    spec = "tests.test_generate:zoo_model"
    cli.main(["generate", "--preprocessed_path", out("prepared"), "--generator", spec, "--output", out("draft")])
    cli.main(["generate", "--preprocessed_path", out("prepared"), "--generator", spec, "--output", out("draft")])
    assert spark.read.parquet(out("draft")).count() == 2
    cli.main(["correct", "--preprocessed_path", out("prepared"), "--input", out("draft"), "--db_path", root,
              "--generator", spec, "--output", out("fixed"), "--retry_num", "1"])
    cli.main(["append", "--dev_path", path, "--input", out("fixed"), "--output", out("pred")])
    cli.main(["slice", "--dev_path", path, "--full", "--output", out("subset"), "--gold_output", out("gold")])
    cli.main(["evaluate", "--dev_path", path, "--predicted_path", out("pred"), "--gold_path", out("gold"),
              "--db_path", root, "--output", out("result")])
    assert {r.sql_idx: r.res for r in spark.read.json(out("result")).collect()} == {0: 1, 1: 0}
    assert "50.00" in capsys.readouterr().out
    cli.main(["train", "--preprocessed_path", out("prepared"), "--input", out("fixed"), "--db_path", root,
              "--output", out("train")])
    assert spark.read.json(out("train")).count() == 2
    cli.main(["integrate", "--json_lines", "--output", out("both"), out("train"), out("train")])
    assert spark.read.json(out("both")).count() == 4


def zoo_model():
    return LookupGenerator([("How heavy", "Weight FROM Animal WHERE Name LIKE 'ANIMAL 3'"), ("Which", "Nam FROM Keeper")])


def test_stream_resumes(spark, context, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    model = LookupGenerator([], default="1")

    def run():
        step = lambda batch: draft_queries(batch, model)
        process_new_files(spark, source, target, marks, step).awaitTermination()
        return spark.read.parquet(target).select("sql_idx").collect()

    context.where("sql_idx < 2").write.json(source)
    assert sorted(r.sql_idx for r in run()) == [0, 1]
    context.where("sql_idx = 2").write.mode("append").json(source)
    assert sorted(r.sql_idx for r in run()) == [0, 1, 2]
    assert sorted(r.sql_idx for r in run()) == [0, 1, 2]
