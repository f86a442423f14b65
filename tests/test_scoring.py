"""Result match, accuracy, efficiency and guarded execution."""

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions.dialect import any_value_of, to_spark_sql
from sqlgauge.operators import scoring
from sqlgauge.operators import batch
from sqlgauge.operators.execute import Executor, evaluation_pairs, parquet_tables

FOLDER = "/root/testdata/sf0.001"


def rows(spark, values, ddl):
    return spark.createDataFrame(values, ddl)


def match(a, b):
    return scoring.result_match(a, b).first().res


def test_result_match(spark):
    one = rows(spark, [(1, None), (2, "x"), (2, "x")], "a int, b string")
    same = rows(spark, [(2.0, "x"), (1.0, None)], "p double, q string")
    assert match(one, same) == 1
    assert match(one, rows(spark, [(1, None)], "a int, b string")) == 0
    assert match(one, same.select("q", "p")) == 0
    assert match(rows(spark, [("1",)], "a string"), rows(spark, [(1,)], "a int")) == 0
    empty_text, empty_pair = rows(spark, [], "a string"), rows(spark, [], "a int, b int")
    assert match(empty_text, empty_pair) == 1
    assert match(empty_text, rows(spark, [], "b string")) == 1
    assert match(one, one.limit(0)) == 0
    assert match(rows(spark, [(True,)], "a boolean"), rows(spark, [(1,)], "a int")) == 1
    big = 2**53
    assert match(rows(spark, [(big,)], "a long"), rows(spark, [(big + 1,)], "a long")) == 0
    assert match(rows(spark, [(None,)], "a int"), rows(spark, [(None,)], "a string")) == 0


def test_frequent_row_is_no_hot_key(spark):
    many = spark.range(200000).select(F.lit("same").alias("a"))
    assert match(many, rows(spark, [("same",)], "a string")) == 1


def test_accuracy(spark):
    samples = rows(
        spark,
        [(0, "select a from t", None), (1, "select 1", None), (2, None, "simple"), (3, None, "moderate")],
        "sql_idx long, gold_sql string, difficulty string",
    )
    results = rows(spark, [(0, 1), (1, 0), (2, 0)], "sql_idx long, res int")
    got = {r.level: (r["count"], r.accuracy) for r in
           scoring.accuracy_by_difficulty(results, samples).collect()}
    assert got["simple"] == (2, 50.0) and got["moderate"] == (0, 0.0)
    assert got["challenging"] == (1, 0.0) and got["total"][0] == 3
    assert got["total"][1] == pytest.approx(100 / 3)
    text = scoring.report(scoring.accuracy_by_difficulty(results, samples), "accuracy")
    assert "simple" in text and "33.33" in text
    nothing = scoring.accuracy_by_difficulty(results.limit(0), samples).collect()
    assert {(r["count"], r.accuracy) for r in nothing} == {(0, 0.0)}


def test_efficiency(spark):
    # 20 equal values and one far away: only the latter is dropped. Key 1 never varies.
    data = [(0, 1.0)] * 20 + [(0, 100.0)] + [(1, 4.0)] * 3 + [(2, 0.0)]
    timings = rows(spark, data, "sql_idx long, ratio double")
    ratios = scoring.time_ratios(timings)
    assert {r.sql_idx: r.time_ratio for r in ratios.collect()} == {0: 1.0, 1: 4.0, 2: 0.0}
    assert scoring.efficiency_score(ratios).first().ves == pytest.approx(100.0)
    assert scoring.efficiency_score(ratios.limit(0)).first().ves == 0.0


@pytest.fixture(scope="module")
def executor(spark):
    return Executor(spark, {"shop": parquet_tables(FOLDER, ["customer", "orders", "part", "lineitem"])})


def test_outcomes(executor):
    assert executor.check("shop", "SELECT count(*) FROM orders;").ok
    shown = executor.preview("shop", "SELECT o_orderkey FROM orders ORDER BY 1")
    assert shown.ok and shown.value == [(i,) for i in range(10)]
    for sql, condition in [
        ("SELECT * FROM missing", "TABLE_OR_VIEW_NOT_FOUND"),
        ("SELECT nothing FROM orders", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
        ("SELEC 1", "PARSE_SYNTAX_ERROR"),
        ("SELECT 1 FROM", "ValueError"),
    ]:
        outcome = executor.check("shop", sql)
        assert not outcome.ok and outcome.condition == condition and outcome.error
    assert executor.check("nowhere", "SELECT 1").condition == "KeyError"


def test_timeout_cancels_the_jobs(spark, executor):
    product = "SELECT count(*) FROM lineitem a, lineitem b, lineitem c WHERE a.l_tax + b.l_tax > c.l_tax"
    slow = Executor(spark, executor.databases, timeout=3)
    outcome = slow.check("shop", product)
    assert (outcome.ok, outcome.condition) == (False, "TIMEOUT")
    assert outcome.seconds < 20
    tracker = spark.sparkContext.statusTracker()
    for _ in range(100):
        if not tracker.getActiveJobsIds():
            break
        import time

        time.sleep(0.2)
    assert not tracker.getActiveJobsIds()


def test_dialect(executor):
    def first(sql):
        outcome = executor.preview("shop", sql)
        assert outcome.ok, outcome.error
        return outcome.value[0]

    assert first("SELECT count(*) / 7 FROM orders WHERE o_orderkey < 15") == (2,)
    assert first("SELECT 1 / 0") == (None,)
    assert first("SELECT count(*) FROM part WHERE p_name LIKE '%BLUE%'")[0] > 0
    assert first("SELECT iif(1 < 2, 'y', 'n'), strftime('%Y-%m', '2020-05-06')") == ("y", "2020-05")
    assert first('SELECT "o_orderkey" FROM orders WHERE o_orderkey = 3') == (3,)
    assert first("SELECT group_concat(x) FROM (SELECT 'a' AS x UNION ALL SELECT 'a')") == ("a,a",)
    assert first("SELECT o_orderstatus, count(*) FROM orders GROUP BY o_custkey LIMIT 1")[1] > 0
    assert to_spark_sql("select 'a like b' where x like 'c'", set(), set()) == (
        "select 'a like b' where x ILIKE 'c'"
    )
    assert to_spark_sql("select a / b, a / c from t", set(), {"a", "b"}) == "select a div b, a / c from t"
    assert any_value_of("select t.a, count(*) from t group by b", "a") == (
        "select any_value(t.a), count(*) from t group by b"
    )


def test_evaluate(spark, executor):
    gold = rows(spark, [
        (0, "shop", "SELECT o_custkey FROM orders"),
        (1, "shop", "SELECT count(*) FROM orders"),
        (2, "shop", "SELECT c_name FROM customer"),
        (3, "shop", "SELECT p_name FROM part"),
    ], "sql_idx long, db_id string, gold_sql string")
    predictions = rows(spark, [
        (2, "SELECT c_nam FROM customer"),
        (0, "SELECT DISTINCT o_custkey FROM orders ORDER BY 1 DESC"),
        (1, "SELECT count(*) FROM orders WHERE o_orderkey > 0"),
    ], "sql_idx long, predicted_sql string")
    pairs = evaluation_pairs(predictions, gold)
    got = {r.sql_idx: r.res for r in executor.evaluate(pairs).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0}
    conditions = {r.sql_idx: r.condition for r in executor.evaluate(pairs).collect()}
    assert conditions == {0: None, 1: None, 2: "UNRESOLVED_COLUMN.WITH_SUGGESTION", 3: "PARSE_EMPTY_STATEMENT"}
    timed = executor.time_pairs(pairs.where("sql_idx in (0, 2)"), iterations=2)
    by_key = {}
    for r in timed.collect():
        by_key.setdefault(r.sql_idx, []).append(r.ratio)
    assert len(by_key[0]) == 2 and min(by_key[0]) > 0 and by_key[2] == [0.0]


def statements(spark, n, shapes):
    """(sql_idx, db_id, predicted_sql, gold_sql): n pairs, predictions by turns from ``shapes``."""
    gold = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < {k}"
    return rows(spark, [(i, "shop", shapes[i % len(shapes)].replace("{k}", str(i)), gold.replace("{k}", str(i))) for i in range(n)],
                "sql_idx long, db_id string, predicted_sql string, gold_sql string")


SAME = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < {k} ORDER BY 2"
OTHER = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey <= {k}"


def test_a_window_is_one_job(spark, executor):
    pairs = statements(spark, 12, [SAME, OTHER])
    seen = []
    original = batch.Batches._write
    batch.Batches._write = lambda self, df: (seen.append(df.count()), original(self, df))[1]
    try:
        got = {r.sql_idx: r.res for r in batch.evaluate(executor, pairs, window=12).collect()}
    finally:
        batch.Batches._write = original
    assert got == {i: int(i % 2 == 0) for i in range(12)} and seen == [12]


def test_failing_statements_are_singled_out(spark, executor):
    broken = "SELECT o_orderkey, raise_error('stop') FROM orders"
    shapes = [SAME, OTHER, SAME, SAME, SAME, broken, "SELECT 1 FROM", SAME, "SELECT o_orderkey FROM orders WHERE o_orderkey < {k}"]
    pairs = statements(spark, 20, shapes)
    got = {r.sql_idx: (r.res, r.condition) for r in batch.evaluate(executor, pairs, window=7).collect()}
    for i in range(20):
        want = {1: (0, None), 5: (0, "USER_RAISED_EXCEPTION"), 6: (0, "ValueError"), 8: (0, None)}.get(i % 9, (1, None))
        assert got[i] == want, i


def test_slow_statements_are_cancelled_and_the_others_scored(spark, executor):
    slow = "SELECT count(*), 1 FROM lineitem a, orders b, orders c WHERE a.l_tax + b.o_totalprice > c.o_totalprice"
    quick = Executor(spark, executor.databases, timeout=6)
    pairs = statements(spark, 3, [SAME, slow, OTHER])
    got = {r.sql_idx: (r.res, r.condition) for r in batch.evaluate(quick, pairs).collect()}
    assert got == {0: (1, None), 1: (0, "TIMEOUT"), 2: (0, None)}


def test_equal_statements_run_once(spark, executor):
    pair = (SAME.replace("{k}", "9"), OTHER.replace("{k}", "8"))
    pairs = rows(spark, [(i, "shop", *pair) for i in range(50)] + [(99, "nowhere", *pair), (100, "shop", None, pair[1])],
                 "sql_idx long, db_id string, predicted_sql string, gold_sql string")
    got = {r.sql_idx: (r.res, r.condition) for r in executor.evaluate(pairs).collect()}
    assert got == {**{i: (1, None) for i in range(50)}, 99: (0, "KeyError"), 100: (0, "PARSE_EMPTY_STATEMENT")}


def test_windows_of_nothing(spark, executor):
    none = rows(spark, [], "sql_idx long, db_id string, predicted_sql string, gold_sql string")
    assert executor.evaluate(none).collect() == [] and executor.check_all(none).collect() == []


def test_union_compares_like_a_pair(spark):
    """Values, types and NULLs as in test_result_match, all in one window."""
    texts = [
        ("SELECT 1 AS a, 'x' AS b", "SELECT 1.0D AS u, 'x' AS v", 1), ("SELECT '1' AS a", "SELECT 1 AS a", 0),
        ("SELECT NULL AS a", "SELECT CAST(NULL AS STRING) AS a", 1), ("SELECT 0.0D AS a", "SELECT -0.0D AS a", 1),
        ("SELECT true AS a", "SELECT 1 AS a", 1), ("SELECT 1 AS a", "SELECT 1 AS a, 2 AS b", 0),
        ("SELECT 1 AS a WHERE false", "SELECT 1 AS a, 2 AS b WHERE false", 1), ("SELECT 1 AS a", "SELECT 1 AS a WHERE false", 0),
        ("SELECT explode(array(1, 1, 2)) AS a", "SELECT explode(array(2, 1)) AS a", 1),
        ("SELECT array(1, 2) AS a", "SELECT array(1, 2) AS a", 1), ("SELECT 'a,b' AS a, 'c' AS b", "SELECT 'a' AS a, 'b,c' AS b", 0),
        ("SELECT DATE '2020-01-01' AS a", "SELECT '2020-01-01' AS a", 1), ("SELECT '' AS a", "SELECT CAST(NULL AS STRING) AS a", 0),
    ]
    window = [(i, spark.sql(p), spark.sql(g)) for i, (p, g, _) in enumerate(texts)]
    got = {r.statement: r.res for r in batch.match_window(window).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(texts)}
    assert got == {r.sql_idx: r.res for r in scoring.match_table(window).collect()}


def test_shown_results(spark, executor):
    drafts = rows(spark, [
        (0, "shop", "SELECT o_orderkey FROM orders WHERE o_orderkey < 12 ORDER BY 1 DESC"),
        (1, "shop", "SELECT 'it''s', NULL, 1.5, 'x' FROM orders WHERE o_orderkey = 1"),
        (2, "shop", "SELECT 1 FROM orders WHERE o_orderkey < 0"), (3, "shop", "SELECT x FROM orders"),
    ], "sql_idx long, db_id string, predicted_sql string")
    got = {r.sql_idx: r for r in executor.check_all(drafts, 2).collect()}
    assert got[0].message == "[(11,), (10,)]" and got[1].message == """[("it's", None, 1.5, 'x')]"""
    assert got[2].message == "[]" and got[2].ok and not got[3].ok and "x" in got[3].message
    assert len(executor.check_all(drafts, None).where("sql_idx = 0").first().message.split("), (")) == 12


def test_window_known_to_fail_is_not_run_again(spark):
    """Once the first half has run, the second must hold the failure and is halved at once."""
    from types import SimpleNamespace

    from sqlgauge.operators.batch import Batches

    tried, blamed = [], []

    def guarded(work, timeout):
        now = work()
        tried.append(now)
        return SimpleNamespace(ok=3 not in now, condition="BAD", error="bad")

    batches = Batches(SimpleNamespace(spark=spark, timeout=1, parallelism=1, guarded=guarded), "statement long", "none")
    batches._write = lambda outcome: outcome
    window = [(i,) for i in range(4)]
    assert not batches._halves(window, lambda w: [s[0] for s in w], lambda spark, *b: blamed.append(b[0]))
    assert tried == [[0, 1, 2, 3], [0, 1], [2], [3]]
    assert blamed == [3]
