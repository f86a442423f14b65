"""Statements that differ only in numbers are run as one, with the outcomes that each has alone."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.operators import batch, shapes
from sqlgauge.operators.execute import Executor


@pytest.fixture()
def executor(spark, tmp_path):
    rows = [(k, None if k % 7 == 0 else k % 3, f"t = {k}", float(i)) for k in range(40) if k % 10 for i in range(k % 4)]
    spark.createDataFrame(rows, "k long, a int, s string, v double").write.parquet(f"{tmp_path}/t")
    return Executor(spark, {"db": {"t": lambda session: session.read.parquet(f"{tmp_path}/t")}})


def counted(executor, monkeypatch):
    """The texts that get a plan of their own, as they come."""
    seen, query = [], executor.query
    monkeypatch.setattr(executor, "query", lambda db_id, sql, by=(): (seen.append(sql), query(db_id, sql, by))[1])
    return seen


def pairs(spark, shapes_of_k, n=40):
    gold = "SELECT k, v FROM t WHERE k = {k}"
    rows = [(i, "db", shapes_of_k(i).replace("{k}", str(i)), gold.replace("{k}", str(i))) for i in range(n)]
    return spark.createDataFrame(rows, "sql_idx long, db_id string, predicted_sql string, gold_sql string")


def each_alone(executor, frame):
    """Outcomes of one statement after the other."""
    return {r.sql_idx: executor.matches(r.db_id, r.predicted_sql, r.gold_sql) for r in frame.collect()}


def test_a_shape_is_planned_once(spark, executor, monkeypatch):
    texts = ["SELECT DISTINCT k, v FROM t WHERE k = {k} ORDER BY 2", "SELECT k, v FROM t WHERE v > 0 AND t.k = {k}",
             "SELECT k, w FROM t WHERE k = {k}", "SELECT k FROM t WHERE k ={k}", "SELECT v, s FROM t WHERE k = {k}"]
    frame = pairs(spark, lambda i: texts[i % 5], 30)
    want = each_alone(executor, frame)
    seen = counted(executor, monkeypatch)
    got = {r.sql_idx: (r.res, r.condition) for r in batch.evaluate(executor, frame, window=16).collect()}
    assert got == {i: (o.value or 0, o.condition) for i, o in want.items()}
    assert {i for i, (res, _) in got.items() if res} and {c for _, c in got.values()} == {None, "UNRESOLVED_COLUMN.WITH_SUGGESTION"}
    assert len(seen) < 10  # 60 if each had a plan


def test_failures_of_a_shape_are_singled_out(spark, executor):
    """Only statements that meet a row fail; a shape that fails here and there is halved."""
    texts = ["SELECT k, raise_error('stop') FROM t WHERE k = {k}", "SELECT k, if(k = 13, raise_error('stop'), v) FROM t WHERE k = {k}"]
    for text in texts:
        frame = pairs(spark, lambda i: text, 20)
        want = {i: (o.value or 0, o.condition) for i, o in each_alone(executor, frame).items()}
        got = {r.sql_idx: (r.res, r.condition) for r in batch.evaluate(executor, frame, window=4).collect()}
        assert got == want and {c for _, c in got.values()} == {None, "USER_RAISED_EXCEPTION"}


def test_rows_are_shown_as_alone(spark, executor, monkeypatch):
    texts = ["SELECT a, v FROM t WHERE k = {k} ORDER BY 1 DESC, 2", "SELECT v FROM t WHERE k = {k} ORDER BY v DESC NULLS FIRST",
             "SELECT v FROM t WHERE k = {k}", "SELECT s, k FROM t WHERE k = {k} AND s <> 't = 3' ORDER BY s"]
    drafts = pairs(spark, lambda i: texts[i % 4]).drop("gold_sql")
    for rows in (2, None):
        got = {r.sql_idx: (r.ok, r.message) for r in batch.check_all(executor, drafts, rows, window=16).collect()}
        apart = {r.sql_idx: (r.ok, r.message) for r in batch.check_all(executor, drafts, rows, window=999).collect()}
        assert got == apart and got[10] == (True, "[]") and got[3] == (True, "[]") and len({m for _, m in got.values()}) > 10
    seen = counted(executor, monkeypatch)
    batch.check_all(executor, drafts.where("sql_idx % 4 < 2"), 2, window=16)
    assert len(seen) == 2  # one for the order of each shape


def test_slots_are_numbers_that_names_are_compared_with(spark):
    texts = ["SELECT 'a = 1' FROM t WHERE k = 12 AND v= 3", "k >= 1 AND k == 2 AND 3 != k", "k = 1.5 OR k = 1e3 OR k = -1",
             "k = 1234567890", 'k = 1 AND "s" = 2', "k = 1 -- 'x", "k = ? AND k = 1"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [(r.shape, r.slots) for r in frame.orderBy("i").select(shapes.shape_of(["t"]).alias("shape"), shapes.slots_of(["t"]).alias("slots")).collect()]
    assert got[0] == ("""["SELECT 'a = 1' FROM t WHERE k = ? AND v= ?"]""", [12, 3])
    assert [s for s, _ in got[1:]] == [None] * 6


def test_products_and_other_plans_are_not_shared(spark, executor):
    spark.createDataFrame([(1, 2, 3)], "statement long, slot_0 int, slot_1 int").createOrReplaceGlobalTempView("asked_here")
    def shared(text):
        return shapes.shared_frames(executor, "db", [text], "asked_here")

    assert shared("SELECT v FROM t WHERE k = 2")[0].columns == ["statement", "c0"]
    for text in ["SELECT v FROM t WHERE k = 2 OR v > 1", "SELECT count(*) FROM t WHERE k = 2", "SELECT v FROM t WHERE k = 2 LIMIT 1",
                 "SELECT x.v FROM t x JOIN t y ON x.k = y.k WHERE x.k = 2", "SELECT v FROM t WHERE k < 2000000000 AND k = 1"]:
        assert shared(text) is None
    spark.catalog.dropGlobalTempView("asked_here")


def test_parts_that_fail():
    def failing(bad, n, window):
        tried = []
        return batch._failed_parts(lambda parts, part: not (tried.append((parts, part)) or any(b % parts == part for b in bad)), n, window), tried

    assert failing([], 64, 4) == ([], [(1, 0)])
    found, tried = failing([5], 64, 4)
    assert found == [(16, 5)] and len(tried) == 9
    assert failing(range(64), 64, 4)[0] == [(4, i) for i in (0, 2, 1, 3)]


def test_a_copy_is_read_by_one_file(spark, executor):
    text = "SELECT k, a, s, v FROM t WHERE k = 13"
    by = executor.query("db", text, (("t", "k"),))
    assert sorted(by.collect()) == sorted(executor.query("db", text).collect())
    scan = by._jdf.queryExecution().sparkPlan()
    while scan.children().size():
        scan = scan.children().apply(0)
    assert scan.optionalBucketSet().get().cardinality() == 1 and scan.relation().bucketSpec().get().numBuckets() > 1
    assert executor.query("db", "SELECT * FROM t", (("t", "k"),)).exceptAll(executor.query("db", "SELECT * FROM t")).isEmpty()
    assert shapes.looked_up({"t": ["K", "v"], "u": ["k"]}, ["SELECT v FROM T x WHERE x.k = 3 AND v = 4"]) == (("t", "K"),)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sqlgauge_")]
