"""Canonical SQL, skeletons, cleanup and difficulty on hand-worked texts."""

import random

import pytest
from pyspark.sql import functions as F

from sqlgauge.functions import prompts
from sqlgauge.functions import text as tx
from sqlgauge.functions.difficulty import difficulty, occurrences, operator_count, table_count
from sqlgauge.functions.wordlists import STOP_WORDS


def apply(spark, function, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", function(F.col("t")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


NORMALIZE = [
    ("SELECT  a FROM  b ;", "select a from b"),
    ('select "X y" from T where c = "It"', "select 'X y' from t where c = 'It'"),
    ("SELECT count(*) FROM t ORDER BY count(*)", "select count ( * ) from t order by count ( * ) asc"),
    # A column called description is no direction.
    ("SELECT description FROM t ORDER BY x", "select description from t order by x asc"),
    ("select x from t order by x desc", "select x from t order by x desc"),
    # every key has its own direction
    ("SELECT a FROM t ORDER BY a, b DESC, max(c) LIMIT 3",
     "select a from t order by a asc , b desc , max ( c ) asc limit 3"),
    ("select a from (select b from u order by b, c) order by a + b, t.c",
     "select a from ( select b from u order by b asc , c asc ) order by a + b asc , t.c asc"),
    ("select t12.a from x as t12 where t1.b = t120.c", "select x.a from x where t1.b = t120.c"),
    # t1 does not touch t10 or at1, and a string is left alone.
    (
        "SELECT T1.a, T10.b, at1 FROM x AS T1 JOIN y AS T10 ON T1.k = T10.k WHERE z = 't1 T1'",
        "select x.a , y.b , at1 from x join y on x.k = y.k where z = 't1 T1'",
    ),
    ("select a from x as t1", "select a from x"),
    ("select a>=-1, b-1 from t", "select a >= -1 , b - 1 from t"),
    ("select 'it''s', 1.5 from t", "select 'it''s' , 1.5 from t"),
    ("", ""),
]


def test_normalize(spark):
    got = apply(spark, tx.normalize_sql, [t for t, _ in NORMALIZE])
    assert got == [want for _, want in NORMALIZE]


def plain_lower(text):
    out, quoted = "", False
    for c in text:
        out += c if quoted else c.lower()
        quoted ^= c == "'"
    return out


def test_lower_outside_quotes(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("AbC '") for _ in range(rng.randint(0, 15))) for _ in range(200)]
    assert apply(spark, tx.lower_outside_quotes, texts) == [plain_lower(t) for t in texts]


def test_skeleton(spark):
    names = F.array(*[F.lit(n) for n in ("*", "t", "u", "a", "b", "t.a", "u.b", "t.*")])
    cases = [
        ("select t.a , u.b from t join u on t.a = u.b and t.a = u.b where t.a > -3",
         "select _ from _ where _"),
        ("select a , b , a from t where a = 1 and b != 'x' or a <= 2.5", "select _ from _ where _"),
        ("select a from t where a in ( select b from u )", "select _ from _ where _ in ( select _ from _ )"),
        ("select max ( a ) from t group by b having count ( * ) >= 2",
         "select max ( _ ) from _ group by _ having count ( _ ) >= _"),
        ("select t.a from t join u on t.a = u.b and t.a = u.b or a = b join t on a = b group by a , b",
         "select _ from _ group by _"),
        ("select a from t join u on t.a > u.b where a between 1 and 2 and b = 3", "select _ from _ on _ where _ between _ and _ and _"),
        ("select a from t where a like 'x y%' limit 3", "select _ from _ where _ like _ limit _"),
    ]
    got = apply(spark, lambda c: tx.sql_skeleton(c, names), [t for t, _ in cases])
    assert got == [want for _, want in cases]


def test_questions_and_lines(spark):
    got = apply(spark, tx.clean_question, ["  What’s ‘it’ “now”? \n", "　plain\t"])
    assert got == ["What's 'it' 'now'?", "plain"]
    assert apply(spark, tx.squeeze_lines, ["a  b\n  c\t d \n\ne"]) == ["a b\nc d\n\ne"]


def test_generated_text(spark):
    drafts = ["SELECT  ```sql\nSELECT a\nFROM t ```\n", "SELECT  a FROM t WHERE a > = 1 AND b ! = 2"]
    assert apply(spark, tx.clean_draft, drafts) == [
        "SELECT a FROM t", "SELECT a FROM t WHERE a >= 1 AND b != 2"
    ]
    fixed = ["SELECT SELECT a\nFROM t", "SELECTsql\n a", "SELECT ```sql\na\n```"]
    assert apply(spark, tx.clean_correction, fixed) == ["SELECT a FROM t", "SELECT a", "SELECT a"]
    assert apply(spark, tx.unconcat, ["a || ' ' || b", "a || ', ' || b"]) == ["a ,  b", "a ,  b"]


def test_natsql(spark):
    text = "select t.a from t where @.@ join u . b"
    assert apply(spark, tx.natsql_used_columns, [text]) == [["t.a", "."]]
    assert apply(spark, tx.natsql_tokens, ["select t.a x"]) == [["select", "t", "a", "x"]]


def test_token_predicates(spark):
    words = ["1,000", "1e5", "-2", "abc", "nan", "1.5", ".5", "1d", "", " 7 ", "5.", "-3.25", "1.2.3"]

    def is_float_text(w):
        try:
            float(w.replace(",", ""))
            return True
        except ValueError:
            return False

    assert apply(spark, tx.is_number, words) == [is_float_text(w) for w in words]
    assert apply(spark, tx.is_negative_int, ["-3", "3", "-3.5"]) == [True, False, False]
    assert apply(spark, tx.is_float, ["-3.25", "3", "a.b", "1.2.3"]) == [True, True, False, False]
    assert apply(spark, tx.is_stopword, [" the ", "The", "no", "id"]) == [True, False, False, False]
    assert apply(spark, tx.is_commonword, ["no", "yes ", "the"]) == [True, True, False]
    assert apply(spark, tx.is_common_db_term, ["id", "ids"]) == [True, False]
    assert apply(spark, tx.is_span_separator, list("'\"()`,.?! a-")) == [True] * 10 + [False] * 2
    assert "no" not in STOP_WORDS and len(STOP_WORDS) == 178


def test_prefix_match(spark):
    pairs = [("(abc", "a"), ("abc", "bbc"), ("...", ",."), ("", ""), ("a", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.r for r in df.select(tx.prefix_match(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [True, False, True, True, False]


def plain_difficulty(sql):
    sql = sql.lower().replace("(*)", "").replace("( * )", "")
    words = sql.split()
    tables = {words[i + 1] for i, w in enumerate(words[:-1]) if w in ("from", "join")}
    ops = ["not", "between", "=", ">", "<", ">=", "<=", "!=", "in", "like", "is", "exists", "-", "+",
           "*", "/", "max", "min", "count", "sum", "avg", "and", "or", "intersect", "union", "except",
           "desc", "asc"]
    n = sum(sql.count(op) for op in ops)
    if len(tables) == 1:
        return n, 1, "simple" if n <= 6 else "moderate"
    return n, len(tables), "challenging"


def test_difficulty(spark):
    texts = [
        "SELECT count(*) FROM t",
        "SELECT a FROM t JOIN u ON t.x = u.x",
        "SELECT a FROM t ORDER BY a DESC",
        "SELECT max(a), min(b) FROM t WHERE a >= 1 AND b != 2 OR c LIKE 'in'",
        "SELECT 1",
        "select a from t except select a from t",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for r in df.select("t", operator_count(c).alias("n"), table_count(c).alias("k"),
                       difficulty(c).alias("d")).collect():
        assert (r.n, r.k, r.d) == plain_difficulty(r.t)
    assert apply(spark, lambda x: occurrences(x, "aa"), ["aaaa", "aaa", "b"]) == [2, 1, 0]


def test_prompt_lines(spark):
    df = spark.createDataFrame([("q {sql}", None), ("p", "k")], "q string, k string")
    filled = prompts.fill("### Q: {question}\n### K: {knowledge}\nSELECT",
                          question=F.col("q"), knowledge=F.col("k"))
    assert [r.t for r in df.select(filled.alias("t")).collect()] == [
        "### Q: q {sql}\nSELECT", "### Q: p\n### K: k\nSELECT"
    ]


def test_templates_have_only_known_fields():
    """Every template can be filled by its caller; correction shows the error."""
    for template in (prompts.REFLECT, prompts.CORRECT):
        for field in ("question", "knowledge", "schema", "foreign_keys", "previous_information"):
            assert "{" + field + "}" in template


def test_new_example_reply(spark):
    reply = "New Question: How many?\nNew External Knowledge: none\nNew Gold SQL: SELECT 1\n"
    got = apply(spark, lambda c: prompts.parse_new_example(c, True), [reply])[0]
    assert (got.question, got.knowledge, got.sql) == ("How many?", "none", "SELECT 1")
    short = "New Question: How many?\nNew Gold SQL: SELECT 2"
    got = apply(spark, lambda c: prompts.parse_new_example(c, False), [short])[0]
    assert (got.question, got.knowledge, got.sql) == ("How many?", None, "SELECT 2")


def test_long_prompts(spark):
    assert apply(spark, prompts.is_long, ["word " * 3799, "word " * 3800]) == [False, True]
    with pytest.raises(AttributeError):
        prompts.NO_SUCH_TEMPLATE


def test_clause_profile(spark):
    sql = "select distinct a from t join u on t.x = u.x where b between 1 and 2 or c = 'limit 9 and' limit 12"
    got = apply(spark, tx.clause_profile, [sql])[0]
    assert (got.tables, got.limit, got.is_distinct, got.n_joins, got.n_conditions) == (
        ["t", "u"], 12, True, 1, 3
    )
