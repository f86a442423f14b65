"""Mixing, hard negatives and whitening against brute force, with nulls, ties, repeats and odd vectors."""

import math
import random
import re

import numpy as np
import pytest

import __spark_entry__ as contract
from sqlgauge.llm import mining, mixing, whitening
from sqlgauge.llm.sharding import _scatter, round_keys
from tests.compare import connect, difference

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, size int, row string, slot int, `before_size` string, key int"
VECTORS = "vec_id long, embedding array<float>, label int, row string, stripe int, x string, id string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from sqlgauge.session import ship_package

    ship_package(spark)


# --- mixing ---------------------------------------------------------------------------------


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x", 2, "y", 3) for i, t, s in rows], DOCS).repartition(3)


def text_of(n, r):
    return " ".join(r.choice(["a", "éé", "two\tthree", "x y", "\n"]) for _ in range(n))


def words_in(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixing_rows():
    r = random.Random(3)
    rows = [(i, text_of(r.randrange(0, 60), r), "hot" if i % 3 else r.choice(["a", "B", "é", "tiny", None])) for i in range(240)]
    rows += [(900, text_of(30_000, r), "hot"), (901, None, "a"), (902, "", "void"), (903, " \n", None), (904, "w", "one")]
    rows += [(None, "null id", "a"), (7, "again seven", "a"), (7, "again seven", "a"), (-5, "b c", "B")]
    return rows


def targets_by_rounds(sizes, weights, most):
    """Shares by weight, the excess over each limit given to the others until none is above."""
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = {s: w for s, w in weights.items() if s not in fixed}
        share = {s: rest * w / sum(free.values()) for s, w in free.items()}
        above = {s: most * sizes[s] for s in share if share[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return fixed | share
        fixed |= above


@pytest.mark.parametrize("block", [mixing.BLOCK, 5])
def test_mix(spark, block):
    rows = mixing_rows()
    known, mixed = mixing.mix(docs_frame(spark, rows), block=block)
    docs, pieces = known.collect(), mixed.collect()
    assert len(docs) == len(rows)
    assert sorted(d["size"] for d in docs) == sorted(words_in(t) for _, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + words_in(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = targets_by_rounds(sizes, {s: 1 + k % 3 for k, s in enumerate(order)}, 3)
    for d in docs:
        assert d["source_size"] == sizes[d["source"]] and math.isclose(d["target"], want[d["source"]])
    # no word is taken twice in one repetition, no document more than three times
    taken, seen = {}, set()
    for p in pieces:
        taken[p["row"]] = taken.get(p["row"], 0) + p["n_words"]
        span = [(p["row"], p["repetition"], w) for w in range(p["first_word"], p["first_word"] + p["n_words"])]
        assert not seen.intersection(span)
        seen.update(span)
    assert all(taken.get(d["row"], 0) <= 3 * d["size"] for d in docs)
    by_source, slots, size_of = {}, {}, {}
    for p in pieces:
        by_source[p["source"]] = by_source.get(p["source"], 0) + p["n_words"]
        slots.setdefault(p["slot"], set()).add(p["source"])
        size_of[p["slot"]] = size_of.get(p["slot"], 0) + p["n_words"]
    assert all(abs(by_source.get(s, 0) - want[s]) <= max(1, want[s] / 200) for s in sizes)
    # every slot is one block of one source, and slots have no gaps
    assert all(len(s) == 1 for s in slots.values()) and set(slots) == set(range(len(slots)))
    words = {s: {size_of[k] for k, of in slots.items() if of == {s}} for s in sizes}
    assert all(len(w) <= 1 for w in words.values())
    # each stretch of the schedule holds every source in proportion
    n = len(slots)
    for a in range(0, n, max(1, n // 10)):
        part = range(a, min(n, a + n // 10))
        for s in sizes:
            share = sum(1 for of in slots.values() if of == {s}) / n
            assert abs(sum(1 for k in part if slots[k] == {s}) - share * len(part)) <= 6


def test_mix_report_is_the_sum_of_the_mix_and_repeatable(spark):
    rows = mixing_rows()
    a, b = (sorted(map(str, mixing.mix_report(docs_frame(spark, rows)).collect())) for _ in range(2))
    assert a == b and len(a) == len(rows)


def test_mixed_texts_are_words_of_the_documents(spark):
    rows = [(i, f"w{i}a w{i}b  w{i}c", "s" if i % 2 else "t") for i in range(30)]
    docs = docs_frame(spark, rows)
    texts = mixing.mixed_texts(mixing.mix(docs, block=2)[1], docs).collect()
    assert texts
    for p in texts:
        own = [f"w{p['doc_id']}{c}" for c in "abc"][p["first_word"] : p["first_word"] + p["n_words"]]
        assert p["words"] == " ".join(own)


def test_mix_of_no_words(spark):
    assert mixing.mix_report(docs_frame(spark, []).where("false")).collect() == []
    got = mixing.mix_report(docs_frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_mixing_uses_no_python_worker(spark):
    plan = mixing.mix_report(docs_frame(spark, mixing_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


def test_shuffle_key_matches_the_permutation():
    keys = round_keys(11)
    assert len({(_scatter(i, *keys[0]), _scatter(i, *keys[1])) for i in range(20_000)}) == 20_000


# --- hard negatives ---------------------------------------------------------------------------


def odd_vectors(seed, dim=6, n=300):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((4, dim))
    rows = []
    for i in range(n):
        c = int(r.integers(0, 4)) if i % 3 else 0
        v = centres[c] + 0.4 * r.standard_normal(dim)
        rows.append((i * 5, [float(x) for x in v], c))
    rows += [(5000, rows[3][1], 0), (5050, rows[3][1], 0), (5050, rows[4][1], 1), (None, rows[5][1], 2)]
    rows += [(5100, None, 1), (5150, [1.0] * dim, None), (5200, [math.nan] + [1.0] * (dim - 1), 1)]
    rows += [(5250, [math.inf] * dim, 1), (5300, [1.0, None] + [0.0] * (dim - 2), 1), (5350, [0.0] * dim, 3)]
    rows += [(5400, [1.0, 2.0], 1), (5450, [2.0, 2.0], 1), (5451, [1.0, 1.0], 2), (5500, [], 1), (5550, [-x for x in rows[0][1]], 77)]
    return rows


def mined_by_brute_force(rows, every=50, npos=5, nneg=3):
    good = [
        (i, np.floor(256 * np.float32(v).astype(float)), c)
        for i, v, c in rows
        if v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    key = lambda t: (-t[0], t[1] is not None, t[1] or 0)
    out = []
    for at, (i, v, c) in enumerate(good):
        if i is None or i % every:
            continue
        others = [(dot(v, w), j, d) for k, (j, w, d) in enumerate(good) if k != at and len(w) == len(v)]
        for ps, p, _ in sorted((o for o in others if o[2] == c), key=key)[:npos]:
            inside = [o for o in others if o[2] != c and 50 * ps <= 100 * o[0] <= 95 * ps]
            for rank, (ns, g, _) in enumerate(sorted(inside, key=key)[:nneg], 1):
                out.append((i, p, rank, g, ps, ns))
    return out


@pytest.mark.parametrize("scale,blocks", [(1.0, mining._BLOCK), (1.0, 16), (1e9, 64)])
def test_hard_negatives(spark, monkeypatch, scale, blocks):
    monkeypatch.setattr(mining, "_LEAST_STRIPE", 60)
    rows = [(i, v and [x if x is None else x * scale for x in v], c) for i, v, c in odd_vectors(5)]
    frame = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], VECTORS).repartition(3)
    got = [tuple(r) for r in mining.hard_negatives(frame).collect()]
    want = mined_by_brute_force(rows)
    order = lambda t: tuple((x is not None, x or 0) for x in t)
    if scale == 1.0:
        assert sorted(got, key=order) == sorted(want, key=order) and len(want) > 100
    else:  # beyond doubles; scores beyond 64 bits come back as the nearest long
        clipped = [(*w[:4], min(w[4], 2**63 - 1), min(w[5], 2**63 - 1)) for w in want]
        assert sorted(got, key=order) == sorted(clipped, key=order)


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_vertical_scan_drops_no_answer(size):
    r = np.random.default_rng(size)
    n, dim = 1000, 40
    x = np.floor(256 * r.standard_normal((n, dim)) * r.random(dim) ** 3)
    x[::7] = x[3]  # ties
    ids, labels = r.permutation(n), r.integers(0, 3, n)
    parts = np.array_split(np.arange(n), -(-n // size))
    blocks = [mining.Block(p, ids[p], labels[p], x[p]) for p in parts]
    for a in range(0, n, 97):
        s = x @ x[a]
        same = [i for i in range(n) if labels[i] == labels[a] and i != a]
        want = sorted(((int(s[i]), int(ids[i]), i) for i in same), key=lambda t: (-t[0], t[1]))[:5]
        assert mining.positives(blocks, a, labels[a], x[a], 5) == want
        windows = [(int(w[0]) // 2, int(w[0]) * 95 // 100) for w in want]
        found = mining.in_windows(blocks, labels[a], x[a], windows, 3)
        for (low, high), got in zip(windows, found):
            inside = [(int(s[i]), int(ids[i]), i) for i in range(n) if labels[i] != labels[a] and low <= s[i] <= high]
            assert got == sorted(inside, key=lambda t: (-t[0], t[1]))[:3]


def test_vertical_scan_reads_few_dimensions():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.standard_normal((4000, 128)) * 0.9 ** np.arange(128))
    block, left = mining.Block(np.arange(4000), np.arange(4000), np.zeros(4000, int), x), []

    def keep(partial, down, up):
        left.append(len(partial))
        kth = np.partition(partial, len(partial) - 5)[len(partial) - 5] + down if len(partial) > 5 else -np.inf
        return partial + up >= kth

    block.scan(x[0], np.arange(4000), keep)
    assert left[0] == 4000 and left[3] < 400


def test_no_vectors_to_mine(spark):
    frame = spark.createDataFrame([], VECTORS)
    assert mining.hard_negatives(frame).collect() == []
    one = spark.createDataFrame([(50, [1.0, 2.0], 1, "x", 1, "y", "z")], VECTORS)
    assert mining.hard_negatives(one).collect() == []


# --- whitening --------------------------------------------------------------------------------


def whitened_by_numpy(rows, dim):
    x = {
        k: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
        for k, (_, v) in enumerate(rows)
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)
    }
    fit = np.array(sorted(set(map(tuple, x.values()))))
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    centred = (fit * n - np.array(sums)) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], vectors[:, ::-1]


def whitening_rows(dim=24, n=400):
    r = np.random.default_rng(8)
    m = r.standard_normal((n, dim)) @ r.standard_normal((dim, dim)) * 0.3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(m)]
    rows += [(3, rows[9][1]), (3, rows[9][1]), (None, rows[10][1]), (600, None), (601, [math.nan] * dim)]
    return rows + [(602, [1.0, 2.0]), (603, [None] + [0.0] * (dim - 1)), (604, [math.inf] + [0.0] * (dim - 1)), (605, [])]


@pytest.mark.parametrize("fan_in", [whitening._FAN_IN, 2])
def test_whitening(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "_FAN_IN", fan_in)
    rows = whitening_rows()
    frame = spark.createDataFrame([(i, v, 1, "x", 1, "y", "z") for i, v in rows], VECTORS).repartition(7)
    got = whitening.whiten(frame).collect()
    x, n, sums, values, vectors = whitened_by_numpy(rows, 24)
    assert len(got) == 16 * len(x) and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-10
    want = {}
    for k, v in x.items():
        apart = [n * c - s for c, s in zip(v, sums)]
        w = np.array(apart) / n @ vectors / np.sqrt(values)
        want.setdefault((rows[k][0], sum(a * a for a in apart)), []).append(w[:16])
    per_row, signs = {}, {}
    for r in got:
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        per_row.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    assert per_row.keys() == want.keys()
    for key, pairs in per_row.items():
        assert len(pairs) == 16 * len(want[key])
        for c, w in pairs:
            true = want[key][0][c - 1]
            if abs(true) > 1e-3:
                assert signs.setdefault(c, np.sign(true * w)) == np.sign(true * w)
            assert abs(abs(w) - abs(true)) < 1e-8


@pytest.mark.parametrize("kind", ["random", "isotropic", "two equal", "dependent", "few rows", "graded", "constant", "one"])
def test_components_equal_those_of_numpy(kind):
    r = np.random.default_rng(2)
    m = {
        "random": r.standard_normal((300, 50)),
        "isotropic": np.vstack([np.eye(9), -np.eye(9)]),
        "two equal": np.vstack([np.diag([3.0, 2, 2, 1]), -np.diag([3.0, 2, 2, 1])]) @ np.linalg.qr(r.standard_normal((4, 4)))[0],
        "dependent": r.standard_normal((90, 4)) @ r.standard_normal((4, 20)),
        "few rows": r.standard_normal((5, 20)),
        "graded": r.standard_normal((200, 20)) * 10.0 ** -np.arange(20),
        "constant": np.hstack([r.standard_normal((40, 3)), np.full((40, 2), 7.0)]),
        "one": r.standard_normal((30, 1)),
    }[kind]
    m = m - m.mean(0)
    values, z, trace = whitening.components(whitening._triangle([m[:7], m[7:]]), len(m), 99)
    true = np.linalg.svd(m, compute_uv=False) ** 2 / len(m)
    assert len(values) == int((true > 1e-24 * true[0]).sum()) or kind == "graded"
    assert np.abs(values / true[: len(values)] - 1).max() < 1e-10
    v = m.T @ m / len(m)
    assert np.abs(v @ z - z * values).max() < 1e-13 * true[0] * len(m) ** 0.5
    assert np.abs(z.T @ z - np.eye(z.shape[1])).max() < 1e-10 and math.isclose(trace, true.sum())


def test_values_have_high_relative_accuracy():
    # singular values of this bidiagonal matrix span 24 orders of magnitude
    diagonal, upper = 10.0 ** -np.arange(0, 25, 2.0), 10.0 ** -np.arange(1, 25, 2.0)
    from fractions import Fraction

    values = whitening.qd_values(diagonal, upper)
    product = math.prod(Fraction(float(d)) ** 2 for d in diagonal)
    assert abs(float(math.prod(Fraction(float(v)) for v in values) / product) - 1) < 1e-12


def test_whitening_of_little(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, 1, "x", 1, "y", "z") for i, v in rows], VECTORS)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, None), (2, [])])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    two = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in two) == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = whitening.whiten(frame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 5.0])])).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 3} == {None}


@pytest.mark.parametrize("name", ["op11_source_mixing", "op12_hard_negatives"])
def test_queries_equal_sql(spark, name):
    assert difference(spark, connect(DATA), contract.queries()[name], contract.oracle_sql()[name], DATA) is None


def test_whitening_query_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = contract.queries()["op13_embedding_whitening"](spark, DATA).collect()
    x, n, sums, values, vectors = whitened_by_numpy(rows, 64)
    true = {rows[k][0]: (np.array(v) * n - sums) / n @ vectors / np.sqrt(values) for k, v in x.items()}
    sign = {}
    for r in got:
        t = true[r["vec_id"]][r["component"] - 1]
        s = sign.setdefault(r["component"], np.sign(t * r["whitened"]) if abs(t) > 0.1 else None) or np.sign(t * r["whitened"])
        if sign[r["component"]] is None:
            del sign[r["component"]]
        assert abs(t * s - r["whitened"]) < 1e-7
    assert len(got) == 16 * len(rows)
