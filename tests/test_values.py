"""BM25, fuzzy matching and value linking against plain Python models."""

import difflib
import functools
import math
import pickle
import random
import re
from collections import Counter

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sqlgauge.functions.similarity import (
    comparable,
    lcs_length,
    lcs_ratio,
    longest_match,
    match_value,
    may_match,
    shortest_run,
    similarity,
    word_starts,
)
from sqlgauge.functions.wordlists import COMMON_WORDS, SPAN_SEPARATORS, STOP_WORDS
from sqlgauge.operators.joins import measured_bytes, spread_join
from sqlgauge.operators.bm25 import COLUMN_KEY, _counted, build_index, candidates, score_all, score_pairs, top_values
from sqlgauge.operators.values import (
    bm25_scores,
    bm25_texts,
    bm25_topk,
    column_values,
    first_values,
    fuzzy_candidates,
    fuzzy_pairs,
    link_values,
    picklists,
    store_values,
    with_text,
)
from sqlgauge.session import materialise


def lcs_table(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            rows[i + 1][j + 1] = (
                rows[i][j] + 1 if a[i] == b[j] else max(rows[i][j + 1], rows[i + 1][j])
            )
    return rows[-1][-1]


def plain_match(question, value, theta=0.85):
    s, v = question.strip(), value.strip()
    q, fv = [c.lower() for c in s], [c.lower() for c in v]
    m = difflib.SequenceMatcher(None, q, fv).find_longest_match(0, len(q), 0, len(fv))
    if m.size == 0:
        return None
    sep = lambda i: q[i] in SPAN_SEPARATORS
    begin = next((i for i in (m.a, m.a - 1) if i < 0 or sep(i)), None)
    if begin is None:
        return None
    begin = max(begin, 0)
    end = None
    for i in range(m.a + m.size - 1, m.a + m.size + 3):
        if i >= len(q):
            end = len(q) - 1
            break
        if sep(i):
            end = i
            break
    if end is None:
        return None
    while begin < len(q) and sep(begin):
        begin += 1
    while end >= 0 and sep(end):
        end -= 1
    if end - begin + 1 <= 1:
        return None
    text, source = v[m.b : m.b + m.size], s[begin : end + 1]
    a, b, c = text.lower().strip(), source.lower().strip(), v.lower().strip()
    if not a or a == "id":
        return None
    try:
        float(a.replace(",", ""))
        return None
    except ValueError:
        pass
    if {a, b, c} & STOP_WORDS:
        return None
    first = lambda t: next((x for x in t if x not in SPAN_SEPARATORS), t[-1:])
    score = 0.0
    if b.endswith(a + "'s"):
        score = 1.0
    elif first(c) == first(b):
        score = 2 * lcs_table(c, b) / (len(c) + len(b))
    if {a, b, c} & COMMON_WORDS and score < 1:
        return None
    if score < theta or (v.isupper() and score < 1):
        return None
    return text, source, score, m.size


def plain_scores(question, corpus):
    docs = [v.split(" ") for v in corpus]
    n = len(docs)
    mean = sum(map(len, docs)) / n
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if x < 0 else x for t, x in idf.items()}
    out = {}
    for v, d in zip(corpus, docs):
        tf = Counter(d)
        out[v] = round(
            sum(
                idf.get(t, 0.0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / mean))
                for t in question.split(" ")
            ),
            9,
        )
    return out


def plain_link(question, table, column, corpus, is_text, k, keep=2):
    scores = plain_scores(question, corpus)
    picked = sorted(corpus, key=lambda v: (-scores[v], v))[:k]
    chosen, found = [], {}
    if is_text:
        for v in picked:
            m = plain_match(question, v)
            if m:
                found[m[0]] = (v, *m[1:])
        ordered = sorted(
            found.values(), key=lambda x: 1e16 * x[2] + 1e8 * x[2] + x[3], reverse=True
        )
        for v, _, score, _ in ordered:
            if "name" in column and score < 1:
                continue
            chosen.append(v.strip())
            if len(chosen) >= keep:
                break
    for v in picked:
        if len(chosen) >= keep:
            break
        if v not in chosen:
            chosen.append(v)
    return list(dict.fromkeys(chosen))[:keep]


WORDS = ["blue", "ring", "Red", "bolt", "ASIA", "asia", "O'Neil", "no", "the", "id", "x", "12",
         "rings", "blues", "boat", "(red)", "big", "bigger", "name"]


def random_text(rng, low=1, high=4):
    return rng.choice(["", " "]) * (rng.random() < 0.1) + " ".join(
        rng.choice(WORDS) for _ in range(rng.randint(low, high))
    )


def test_lcs_and_similarity():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))
        assert lcs_length(a, b) == lcs_table(a, b)
    assert similarity("kitten", "sitting") == pytest.approx(8 / 13)


def test_native_lcs_ratio(spark):
    pairs = [("kitten", "sitting"), ("", ""), ("a", ""), ("asia", "asian"), ("abcabba", "cbabac")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for row in df.select("a", "b", lcs_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert row.r == pytest.approx(similarity(row.a, row.b))


def test_longest_match_equals_difflib():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += ["".join(rng.choice("abcdefg ") for _ in range(260)), "İ" * 3 + "abc"]
    for _ in range(3000):
        a, b = (tuple(c.lower() for c in rng.choice(texts)) for _ in range(2))
        want = difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b))
        assert longest_match(a, b) == tuple(want)


def test_pair_matcher_equals_model():
    rng = random.Random(2)
    hits = 0
    for _ in range(4000):
        q, v = random_text(rng, 2, 8), random_text(rng)
        if rng.random() < 0.3:
            v = v.upper()
        got, want = match_value(q, v), plain_match(q, v)
        hits += want is not None
        assert got == want or (
            got and want and got[:2] == want[:2] and got[2] == pytest.approx(want[2])
        ), (q, v)
    assert hits > 100


def test_filter_keeps_every_match(spark):
    rng = random.Random(3)
    pairs = [(random_text(rng, 2, 8), random_text(rng)) for _ in range(3000)]
    long = " ".join(rng.choice(WORDS) for _ in range(80))
    pairs += [(long, long), ("see " + long, long[:-2]), ("It's NOT O'Neil's", "O'Neil")]
    df = spark.createDataFrame(pairs, "q string, v string")
    rows = df.select(
        "q", "v", may_match(
            comparable(F.col("q")), word_starts(F.col("q")), comparable(F.col("v"))
        ).alias("may")
    ).collect()
    dropped = sum(not r.may for r in rows)
    assert dropped > len(rows) / 4
    for r in rows:
        assert r.may or plain_match(r.q, r.v) is None, (r.q, r.v)


def make_db(spark, seed, sizes):
    rng = random.Random(seed)
    tables, corpora = {}, {}
    for name, column, size in sizes:
        texts = [random_text(rng) for _ in range(size)]
        df = spark.createDataFrame([(t, float(i % 7)) for i, t in enumerate(texts)],
                                   f"{column} string, num double")
        tables[name] = df
        corpora[(name, column)] = (sorted({t for t in texts if t != ""}), True)
        corpora[(name, "num")] = (sorted({str(float(i % 7)) for i in range(size)}), False)
    return tables, corpora


@pytest.mark.parametrize("seed,k", [(1, 1000), (2, 4), (3, 12), (4, None)])
def test_link_values_equals_model(spark, seed, k):
    tables, corpora = make_db(
        spark, seed, [("parts", "p_name", 40), ("places", "place", 25), ("one", "label", 1)]
    )
    # Few words in many orders: most words are in most values, so idf is negative.
    rng = random.Random(seed)
    mixed = {" ".join(rng.sample(["a1", "b1", "c1", "d1"], rng.randint(3, 4))) for _ in range(30)}
    tables["mix"] = spark.createDataFrame([(m,) for m in sorted(mixed)], "code string")
    corpora[("mix", "code")] = (sorted(mixed), True)
    questions = [(i, "db", random_text(rng, 3, 9) + " a1"[: 3 * (i % 2)]) for i in range(12)]
    qs = spark.createDataFrame(questions, "sql_idx long, db_id string, question string")
    values = store_values(column_values({"db": tables}))

    got_scores = {
        (r.sql_idx, r.table_name, r.column_name, r.value): r.score
        for r in with_text(bm25_scores(qs, values), values).collect()
    }
    got = {
        (r.sql_idx, r.table_name, r.column_name): list(r.matches)
        for r in link_values(qs, values, k=k).collect()
    }
    assert len(got) == len(questions) * len(corpora)
    for i, _, q in questions:
        for (table, column), (corpus, is_text) in corpora.items():
            for v, score in plain_scores(q, corpus).items():
                assert got_scores.get((i, table, column, v), 0.0) == pytest.approx(score, abs=2e-9)
            want = plain_link(q, table, column, corpus, is_text, k)
            assert got[(i, table, column)] == want, (q, table, column, corpus)


def test_hot_word_is_spread_and_complete(spark):
    """A word held by every value: all scores arrive, the top k is exact."""
    rows = spark.range(3000).select(F.concat(F.lit("hot w"), F.col("id")).alias("v"))
    values = store_values(column_values({"db": {"t": rows}}))
    qs = spark.createDataFrame([(0, "db", "hot w7"), (1, "db", "hot")],
                               "sql_idx long, db_id string, question string")
    scores = bm25_scores(qs, values)
    assert scores.groupBy("sql_idx").count().where("count = 3000").count() == 2
    top = with_text(bm25_topk(qs, values, 2), values).where("sql_idx = 0").orderBy("rank").collect()
    assert [r.value for r in top] == ["hot w7", "hot w0"]


@pytest.mark.parametrize("limit", [0, 10**9])
def test_spread_join_is_the_same_either_way(spark, limit):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = materialise(spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, x string"), "r")
    got = spread_join(left, right, ["k"], "id", limit=limit)
    assert got.count() == 334 + 2 * 333
    assert measured_bytes(right) == 3 * (2 * 16 + 1)


def test_places_follow_value_order(spark):
    rng = random.Random(4)
    texts = [(random_text(rng, 1, 3),) for _ in range(500)]
    tables = {"a": spark.createDataFrame(texts, "x string"),
              "b": spark.createDataFrame(texts[:7], "y string")}
    rows = store_values(column_values({"db": tables})).collect()
    for table in ("a", "b"):
        own = sorted((r for r in rows if r.table_name == table), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
        assert [r.value for r in own] == sorted(r.value for r in own)


def test_picklists(spark):
    rows = [("b", 1, 2.5, [1]), ("a", 2, None, None), ("", 2, 10.0, [2]), (None, 3, 9.0, None), ("c", None, 9.0, None), ("a", 2, 9.0, None)]
    df = spark.createDataFrame(rows, "`x y` string, n int, D double, nested array<int>")
    none = df.where("false").select(F.col("x y").alias("z"))
    databases = {"db": {"T": df, "empty": none}, "other": {"T": df.select("n")}}
    got = {(r.db_id, r.table_name, r.column_name): list(r.first_values) for r in picklists(databases, 2).collect()}
    assert got == {("db", "t", "x y"): ["a", "b"], ("db", "t", "n"): ["1", "2"], ("db", "t", "d"): ["10.0", "2.5"], ("other", "t", "n"): ["1", "2"]}
    assert first_values(databases, 10).where("db_id = 'db'").count() == 9
    assert {r.column_name for r in first_values(databases, 1, {("T", "n")}).collect()} == {"n"}


def test_picklists_shuffle_one_row_per_task(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(200_000).selectExpr("concat('v', id) AS a", "id AS b").repartition(4).write.parquet(path)
    got = {r.column_name: list(r.first_values) for r in picklists({"db": {"t": spark.read.parquet(path)}}, 3).collect()}
    assert got == {"a": ["v0", "v1", "v10"], "b": ["0", "1", "10"]}


def test_results_do_not_depend_on_the_join(spark, monkeypatch):
    """Nothing broadcast: the salted joins give the same links and scores."""
    tables, _ = make_db(spark, 7, [("parts", "p_name", 30), ("places", "place", 20)])
    rng = random.Random(7)
    questions = [(i, "db", random_text(rng, 3, 9)) for i in range(8)]
    qs = spark.createDataFrame(questions, "sql_idx long, db_id string, question string")
    stored = store_values(column_values({"db": tables}))

    def results():
        links = {tuple(r)[:4]: tuple(r.matches) for r in link_values(qs, stored, k=6).collect()}
        return links, sorted(map(tuple, bm25_scores(qs, stored).collect()))

    broadcast = results()
    never = functools.partial(spread_join, limit=-1)
    monkeypatch.setattr("sqlgauge.operators.values.spread_join", never)
    monkeypatch.setattr("sqlgauge.operators.bm25.spread_join", never)
    monkeypatch.setattr("sqlgauge.operators.bm25.BROADCAST_BYTES", -1)
    assert results() == broadcast


def corpus_and_questions(spark, n=3000):
    """Values with a few words that nearly all have, and questions full of them."""
    rng = random.Random(9)
    rare = [f"r{i}" for i in range(400)]
    texts = {
        " ".join(["the", "of", "to"] + rng.sample(["a", "in", "is"], 2) + rng.sample(rare, rng.randint(1, 5)) + ["and"] * rng.randint(0, 3))
        for _ in range(n)
    }
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "body string")
    questions = [(i, "db", "the of to " + " ".join(rng.sample(rare, 6))) for i in range(10)]
    questions += [(10, "db", "the of to"), (11, "db", "nothing here"), (12, "db", "the r1 r1 r1")]
    qs = spark.createDataFrame(questions, "sql_idx long, db_id string, question string")
    return store_values(column_values({"db": {"t": df}})), qs


@pytest.mark.parametrize("k", [1, 10, 200])
def test_best_values_are_those_of_all_pairs(spark, k):
    values, qs = corpus_and_questions(spark)
    index = build_index(qs, values)
    order = W.partitionBy("sql_idx", "column_name").orderBy(F.desc("score"), "place")
    every = score_all(index).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    want = sorted(map(tuple, every.select("sql_idx", "place", "score", "rank").collect()))
    got = sorted(map(tuple, top_values(index, k).select("sql_idx", "place", "score", "rank").collect()))
    assert got == want and got


def test_common_words_alone_make_no_candidates(spark):
    values, qs = corpus_and_questions(spark)
    index = build_index(qs.where("sql_idx < 10"), values)
    held = values.select("place", F.split("value", " ").alias("words"))
    asked = qs.select("sql_idx", F.split("question", " ").alias("asked"))
    rare = F.exists(F.array_intersect("words", "asked"), lambda w: w.startswith("r"))
    met = candidates(index, 10).join(held, "place").join(asked, "sql_idx")
    assert met.where(~rare).count() == 0
    assert met.count() < score_all(index).count() / 8


def test_no_text_is_shuffled(spark):
    values, qs = corpus_and_questions(spark, 200)
    words = materialise(qs.select("db_id", F.explode(F.split("question", " ")).alias("token")).distinct(), "w")
    plan = _counted(values, words)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanges and not any("value#" in line for line in exchanges)


def test_few_pairs_leave_postings_in_place(spark):
    """Pairs that are small enough to be broadcast are, and the postings do not move to meet them."""
    values, qs = corpus_and_questions(spark, 200)
    index = build_index(qs, values)
    pairs = score_all(index).select("sql_idx", *COLUMN_KEY, "place")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = score_pairs(index, pairs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_scored_pairs_are_not_shuffled(spark):
    """The words of a question are summed up where they are; scores and texts are those of the salted join."""
    values, qs = corpus_and_questions(spark, 200)
    index = build_index(qs, values)
    plan = score_all(index)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "BY_NUM" not in line]
    assert not any("place#" in line for line in moved), moved
    got = {(r.sql_idx, r.value, r.score) for r in bm25_texts(qs, values).collect()}
    want = {(r.sql_idx, r.value, r.score) for r in with_text(bm25_scores(qs, values), values).collect()}
    assert got == want and len(got) > 200


def test_words_are_counted_whole(spark):
    texts = ["a a b", " a", "b ", "  ", "ü a\tb", "x" * 9, "a b a b a"]
    rows = [("db", "t", "c", i + 1, v) for i, v in enumerate(texts)]
    stored = spark.createDataFrame(rows, "db_id string, table_name string, column_name string, place long, value string")
    words = materialise(spark.createDataFrame([("db", w) for w in ["a", "b", "", "ü"]], "db_id string, token string"), "w")
    got = {(r.place, r.length, r.token, r.tf) for r in _counted(stored, words).collect()}
    want = {(i + 1, len(v.split(" ")), w, v.split(" ").count(w)) for i, v in enumerate(texts) for w in v.split(" ")}
    assert got == {x for x in want if x[2] in {"a", "b", "", "ü"}}


def test_shortest_run_holds_for_every_match():
    rng = random.Random(6)
    for theta in (0.85, 0.7, 1.0):
        for _ in range(3000):
            value = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 14))).strip()
            q = list("x " + value + " y")
            for _ in range(rng.randint(0, 3)):
                q[rng.randrange(2, len(q))] = rng.choice("abc ")
            q = "".join(q)
            found = match_value(q, value, theta) if value else None
            if found:
                run = shortest_run(len(value), theta)
                assert 0 < run <= found[3], (q, value, found)


@pytest.mark.parametrize("names_exact", [False, True])
def test_gram_index_finds_every_match(spark, names_exact):
    rng = random.Random(12)
    tables, corpora = make_db(spark, 12, [("parts", "p_name", 120), ("places", "place", 120)])
    odd = ["ΑΣΟΣ bar", "ασος bar", "İstanbul x", "x" * 70 + " tail of it", "(odd)", "'", "Big Bigger NAME"]
    tables["odd"] = spark.createDataFrame([(t,) for t in odd], "label string")
    corpora[("odd", "label")] = (odd, True)
    texts = [random_text(rng, 3, 9) for _ in range(40)] + [f"is {o}'s here" for o in odd]
    qs = spark.createDataFrame(list(enumerate(["db"] * len(texts))), "sql_idx long, db_id string").join(
        spark.createDataFrame(list(enumerate(texts)), "sql_idx long, question string"), "sql_idx"
    )
    stored = store_values(column_values({"db": tables}))
    got = {
        (r.sql_idx, r.column_name, r.value) for r in fuzzy_pairs(qs, stored, names_exact=names_exact).collect()
    }
    want = set()
    for i, q in enumerate(texts):
        for (_, column), (corpus, is_text) in corpora.items():
            for v in corpus if is_text else ():
                m = plain_match(q, v)
                if m and not (names_exact and "name" in column and m[2] < 1):
                    want.add((i, column, v))
    assert {g for g in got if g in want} == want and len(want) > 100
    if not names_exact:
        assert got == want


def test_gram_index_meets_few_pairs(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    texts = [f"{word()} {word()}" for _ in range(2000)]
    questions = [(i, "db", f"which {texts[i]} and {word()} {word()} {word()}") for i in range(50)]
    qs = spark.createDataFrame(questions, "sql_idx long, db_id string, question string")
    stored = store_values(column_values({"db": {"t": spark.createDataFrame([(t,) for t in texts], "x string")}}))
    asked = qs.select("sql_idx", "db_id", comparable(F.col("question")).alias("asked"))
    values = stored.withColumn("stored", comparable(F.col("value")))
    met = fuzzy_candidates(asked, values)
    assert 50 <= met.count() < 50 * 2000 / 100


def test_fuzzy_scores_are_worked_out_once(spark):
    """A filter on the scores stays behind the shuffle: one Python step, not one on either side."""
    rows = [(1, "shop", "Which small gears did France order?")]
    questions = spark.createDataFrame(rows, "sql_idx long, db_id string, question string")
    words = spark.createDataFrame([("small gear",), ("France",)], "p_name string")
    stored = store_values(column_values({"shop": {"part": words}}))
    found = fuzzy_pairs(questions, stored)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r["match_text"] for r in found.collect()} == {"small gear", "France"}


def test_first_values_read_each_table_once(spark):
    """Any ``k`` takes one scan of a table; nulls, empty texts and repeats do not count."""
    rows = [(v, n) for n, v in enumerate(["b", "", None, "a", "b", "é", "c", "a", "10", "9"] * 30)]
    df = spark.createDataFrame(rows, "v string, n int").repartition(7)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    seen = df.mapInArrow(counted, df.schema)
    got = {}
    for r in first_values({"d": {"T": seen}}, 4).collect():
        got.setdefault(r["column_name"], []).append((r["place"], r["value"]))
    assert sorted(got["v"]) == [(1, "10"), (2, "9"), (3, "a"), (4, "b")]
    assert sorted(got["n"]) == [(1, "0"), (2, "1"), (3, "10"), (4, "100")]
    assert reads.value == len(rows)


def test_heavy_logs_get_tasks_of_bounded_size(spark, tmp_path):
    from sqlgauge.session import widen

    path = str(tmp_path / "log")
    spark.range(400_000).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    assert widen(scan, 100_000).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert widen(scan, 1 << 40).rdd.getNumPartitions() == widen(scan).rdd.getNumPartitions()


def odd_text(rng, alphabet, least, most):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


def test_matcher_equals_pairwise_matches():
    """Values found by stretches, by candidates and as a whole, in turns; runs that cross words and separators."""
    from sqlgauge.functions.similarity import Matcher, _rung

    rng = random.Random(31)
    n_found = 0
    for alphabet in ["abc ", "ab (' ", "abcde  .", "aB'?s ", "aé b", "ab , c"] * 8:
        theta = rng.choice([0.85, 0.7, 1.0])
        values = {i * 3: v for i in range(40) for v in [odd_text(rng, alphabet, 1, 14)] if v.strip()}
        values |= {1: "x" * 190 + " y of it all", 2: "a" * 210, 4: "ab'ab ab", 5: "AB A"}
        grams, words = {}, {}
        for i, v in values.items():
            text = v.strip().lower()
            run = _rung(shortest_run(len(text), theta))
            for p in range(len(text) - run + 1) if run and i % 7 else ():
                grams.setdefault(text[p : p + run], []).append(i)
            for word in re.findall(r"[^'\"()`,.?! ]+", text) if i % 7 == 0 else ():
                words.setdefault(word, []).append(i)
        matcher = pickle.loads(pickle.dumps(Matcher(values, {"db": grams}, {"db": words}, theta)))
        some = list(values.values())
        for _ in range(25):
            parts = [rng.choice([rng.choice(some), rng.choice(some) + "'s", rng.choice(some)[:-1], rng.choice(some).upper(), odd_text(rng, alphabet, 1, 9)])
                     for _ in range(rng.randint(1, 5))]
            q = odd_text(rng, alphabet, 0, 8) + " ".join(parts) + odd_text(rng, alphabet, 0, 4)
            matcher._by_words = rng.random() < 0.8
            got = sorted(matcher.matches("db", q, q.strip().lower()))
            want = {(i, *m) for i, v in values.items() for m in [match_value(q, v, theta)] if m}
            asked = set(re.findall(r"[^'\"()`,.?! ]+", q.strip().lower()))
            met = {w for w in want if w[0] % 7 or asked & set(re.findall(r"[^'\"()`,.?! ]+", values[w[0]].strip().lower()))}
            assert got == sorted(met), q
            n_found += len(met)
        assert matcher.matches("other", "ab ab", "ab ab") == []
    assert n_found > 1000


def test_questions_are_compared_where_they_lie(spark):
    """One row per question goes to Python, and no pairs are shuffled."""
    questions = spark.createDataFrame([(i, "shop", f"Which small gears did France order {i} times?") for i in range(50)],
                                      "sql_idx long, db_id string, question string")
    words = spark.createDataFrame([("small gear",), ("France",), ("large gear",), ("gears",)], "label string")
    stored = store_values(column_values({"shop": {"part": words}}))
    found = fuzzy_pairs(questions, stored)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "Exchange hashpartitioning" not in plan
    assert {(r["value"], r["match_text"]) for r in found.collect()} == {("small gear", "small gear"), ("France", "France"), ("gears", "gears")}


@pytest.mark.parametrize("rows", [25, 0])
def test_large_indexes_lose_grams_or_are_joined(spark, monkeypatch, rows):
    """An index of too many rows keeps the grams of the questions; one that is still too long is not sent to the tasks."""
    from sqlgauge.operators import values as vl

    texts = ["small gear", "France", "large gears", "nobody asks this", "GEARS", "BIG ONE"]
    questions = [(i, "shop", q) for i, q in enumerate(["Which small gears did France order?", "large gear of the big one", None])]
    qs = spark.createDataFrame(questions, "sql_idx long, db_id string, question string")
    stored = store_values(column_values({"shop": {"part": spark.createDataFrame([(t,) for t in texts], "label string")}}))
    want = sorted(map(tuple, fuzzy_pairs(qs, stored).collect()))
    monkeypatch.setattr(vl, "INDEX_ROWS", rows)
    found = fuzzy_pairs(qs, stored)
    assert sorted(map(tuple, found.collect())) == want and len(want) >= 4
    assert ("Exchange hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()) == (rows == 0)


def test_equal_words_are_filled_once(spark, monkeypatch):
    """Questions that ask a column for the same words share one fill; each gets what it has alone."""
    from sqlgauge.operators import values as vl

    rng = random.Random(5)
    texts = [f"{a} {b} {c}" for a in "abc" for b in "abcd" for c in "xyz"]
    stored = store_values(column_values({"db": {"t": spark.createDataFrame([(t, t[-1]) for t in texts], "u string, v string")}}))
    rows = [(i, "db", " ".join(rng.choice("abqx") for _ in range(3))) for i in range(200)]
    qs = spark.createDataFrame(rows, "sql_idx long, db_id string, question string")
    index = build_index(qs, stored)
    alone = {(r.sql_idx, r.column_name): r.fill for r in vl._fill_values(stored, index, 4).collect()}
    seen, fill = [], vl._fill_values
    monkeypatch.setattr(vl, "_fill_values", lambda s, i, n: (seen.append(i.weights.select("sql_idx").distinct().count()), fill(s, i, n))[1])
    got = {(r.sql_idx, r.column_name): r.fill for r in vl._shared_fill(stored, index, 4).collect()}
    assert got == alone and len(got) > 200
    words = {tuple(sorted(q.split())) for _, _, q in rows}
    assert len(seen) == 1 and seen[0] <= len(words) < 40
