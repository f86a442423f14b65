"""The operators against brute force on small tables with nulls, repeats, ties and odd texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash

import __spark_entry__ as contract
import corpus_pipeline
from sqlgauge.llm import bpe, decontam, embeddings, html, language, lines, near, sharding, simhash, substrings, toxicity
from sqlgauge.llm.common import words
from sqlgauge.llm.queries import PATTERN, VOCABULARY
from sqlgauge.llm.suffix_array import suffix_array
from tests.compare import connect, difference

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, fp int, `name` string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from sqlgauge.session import ship_package

    ship_package(spark)


def odd_texts():
    r = random.Random(4)
    sentence = lambda n: " ".join(r.choice("the of ant bee cat dog elk fox gnu hen".split()) for _ in range(n))
    shared = sentence(60)
    out = [None, "", " ", "\n\n", "One", "two words", "é" * 130, "ab" * 200, "x" * 350, "1234 !!! 99"]
    out += [sentence(r.randrange(1, 80)) for _ in range(25)]
    out += [sentence(5) + " " + shared + " " + sentence(5) for _ in range(12)]
    out += [out[15], out[15], out[16], "A Long Enough Line Here\n" + sentence(9), "\ta long enough line here \nz"]
    out += ["a long ENOUGH line here\na long enough line here\n" + sentence(3)]
    out += [" ".join([sentence(30)] * 3), sentence(3000)]
    return out


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "n") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_suffix_array_sorts_all_suffixes():
    r = random.Random(1)
    for _ in range(800):
        s = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(0, 40))]
        s = s * r.choice([1, 1, 3])
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def removed_by_brute_force(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 99):
            w = b[a : a + 100]
            if w in seen:
                gone[a : a + 100] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize("group", [substrings.GROUP, 2])
def test_substrings(spark, group):
    texts = odd_texts()
    got = by_id(substrings.remove_repeats(frame(spark, texts), group=group).select("doc_id", "n_bytes", "cut.*"))
    want = removed_by_brute_force(texts)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) > 1000


def test_lines(spark):
    texts = odd_texts()
    split = [(t or "").split("\n") for t in texts]
    key = lambda x: lowered(x.strip(" \t\n\x0b\x0c\r"))
    holds = {}
    for i, own in enumerate(split):
        for x in own:
            holds.setdefault(key(x), set()).add(i)
    want = {}
    for i, own in enumerate(split):
        kept = [x for x in own if len(key(x)) < 20 or len(holds[key(x)]) < 3 or max(holds[key(x)]) == i]
        want[i] = (len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = by_id(lines.line_report(frame(spark, texts)))
    assert {i: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for i, r in got.items()} == want
    assert sum(w[1] for w in want.values()) >= 3
    kept = lines.drop_repeated_lines(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns
    assert {i: hashlib.sha256((r["text"] or "").encode()).hexdigest() for i, r in by_id(kept).items()} == {
        i: w[2] for i, w in want.items()
    }


def fingerprint(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
    parts = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(n)}


def test_simhash(spark):
    texts = odd_texts() + ["lone " + t for t in odd_texts()[15:20]]
    prints = [fingerprint(t) for t in texts]
    want = components(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = by_id(simhash.near_duplicates(frame(spark, texts)))
    assert {i: r["fp"] % 2**64 for i, r in got.items()} == dict(enumerate(prints))
    assert {i: r["component_id"] for i, r in got.items()} == want
    kept = simhash.keep_one_of_each(frame(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert kept.columns == frame(spark, texts).columns


def similarity(x, y, k=5):
    def counts(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text or ""))
        return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()

    a, b = counts(x), counts(y)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_near_stage_pairs_texts_by_fingerprint(spark):
    """SimHash names the first pairs; one of near prints that is not similar enough stays apart."""
    fp = [0b1011, 0b1011, 0b1000, -1, 0]
    rows = [(i + 10, 0, 0, int(i != 4), x) for i, x in enumerate(fp)]
    own = spark.createDataFrame(rows, "node long, _doc long, _row long, n long, fp long")
    pairs = {tuple(sorted((r["node"], r["b"]))) for r in near._by_fingerprint(own).collect()}
    assert pairs == {(10, 11), (10, 12)}


def test_near_stage_counts_tokens_without_shuffling_them(spark):
    """All tokens of all texts are counted, but what is shuffled does not grow with them."""
    shared = " ".join(f"s{i}" for i in range(9))
    texts = [None, "", "one two"] + [f"{shared} " + " ".join(f"w{k}x{i}" for i in range(2000)) for k in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(2)
    counts = near._counts(docs, 5)
    h, row = near.tokens(pa.array(texts), 5)
    assert (counts == np.bincount(near._bucket(h), minlength=near.BUCKETS)).all()
    common = near.tokens(pa.array([shared]), 5)[0]
    assert counts[near._bucket(common)].min() >= 60 > np.median(counts[near._bucket(h)])
    blocks = near._summed(docs, 5)
    assert blocks.count() <= near.BUCKETS // near.WIDE < len(h) / 2
    assert "Generate" not in blocks._jdf.queryExecution().executedPlan().toString()


def test_near_stage_moves_only_texts_that_are_asked_for(spark):
    rows = [(i, i * 7919, f"text {i}") for i in range(5000)] + [(near.LEAST_LONG, 3, None), (7, 55, "other text of 7")]
    docs = spark.createDataFrame(rows, "_doc long, _row long, _text string")
    ask = [rows[i][:2] for i in (0, 7, 4999, 5000)]
    kept = {(r["_doc"], r["_row"]) for r in near._possible(docs, spark.createDataFrame(ask, "_doc long, _row long")).collect()}
    assert set(ask) <= kept and len(kept) < 20
    assert near._possible(docs, docs.where("false")).count() == 0


def test_near_stage_links_similarity_from_0_8(spark):
    r = random.Random(12)
    texts = odd_texts()
    for n in (12, 40, 150, 400):
        base = [f"w{r.randrange(3000)}" for _ in range(n)]
        for _ in range(25):
            w = list(base)
            for _ in range(r.randrange(0, 2 + n // 30)):
                w[r.randrange(len(w))] = f"v{r.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - r.randrange(0, 1 + n // 12)]))
    texts += [" ".join(["one two three four five six"] * k) for k in (1, 2, 9, 10, 30)]
    like = {(a, b): similarity(texts[a], texts[b]) for a in range(len(texts)) for b in range(a)}
    want = components(len(texts), lambda a, b: like[a, b] >= 0.8 - 1e-12)
    prints = [fingerprint(t) for t in texts]
    assert want != components(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, texts), DATA)
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))
    twice = frame(spark, [texts[60], texts[90], texts[60] + " x", "alone"], [5, 5, 2, 9])
    assert {(x["doc_id"], x["text"]) for x in near.keep_one_of_each(twice).collect()} >= {(5, texts[90]), (9, "alone")}


def test_near_stage_does_not_pair_all_copies_with_many_edits(spark, monkeypatch):
    """Copies of one text, most of them less similar than 0.8, stay few pairs, and all links are found."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(160):
        w = list(base)
        for at in r.sample(range(len(w)), r.randrange(3, 6)):
            w[at] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(w))
    like = {(a, b): similarity(texts[a], texts[b]) for a in range(len(texts)) for b in range(a)}
    want = components(len(texts), lambda a, b: like[a, b] >= 0.8 - 1e-12)
    made, stored = [], near.store

    def store(df, name):
        found = stored(df, name)
        made.append(found.count() if name.endswith("pairs") else 0)
        return found

    monkeypatch.setattr(near, "store", store)
    kept = near.keep_one_of_each(frame(spark, texts))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))
    assert 1 < len(set(want.values())) < len(texts)
    assert sum(made) < len(like) / 8


def test_near_stage_sketches_differ_in_no_more_bits_than_tokens(spark):
    r = random.Random(6)
    texts = [None, "", "a b", *(" ".join(r.choice("abcdefg") for _ in range(r.randrange(1, 900))) for _ in range(20))]
    h, row = near.tokens(pa.array(texts), 5)
    sets = [set(h[row == i].tolist()) for i in range(len(texts))]
    sketches = [list(x.values()) for x in near._sketch(h, row, len(texts)).to_pylist()]
    for x, a in zip(sketches, sets):
        for y, b in zip(sketches, sets):
            differ = sum(((v ^ w) % 2**64).bit_count() for v, w in zip(x, y))
            assert differ <= len(a ^ b) and (differ - len(a ^ b)) % 2 == 0


@pytest.mark.parametrize("seed", range(3))
def test_simhash_posting_lists_miss_no_link(spark, seed):
    r = random.Random(seed)
    prints = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(r.randrange(0, 6)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = components(len(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    rows = [(x - 2**64 if x >= 2**63 else x, i) for i, x in enumerate(prints)]
    links = {(r["a"], r["b"]) for r in simhash.near_links(spark.createDataFrame(rows, "fp long, id long")).collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 3 for a, b in links)
    assert components(len(prints), lambda a, b: (a, b) in links or (b, a) in links) == want


def test_decontamination(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[r.choice(vocabulary) for _ in range(n)] for n in (3, 5, 6, 14, 30, 30, 55)]
    texts = [None, "", "w1 w2"]
    for _ in range(60):
        w = list(r.choice(items))
        for _ in range(r.randrange(0, 3)):
            w[r.choice([0, -1, r.randrange(len(w))])] = "zz"
        pad = [r.choice(vocabulary) for _ in range(r.randrange(0, 30))]
        texts.append(" ".join(pad + w + pad[::-1]))
    from collections import Counter

    def counts(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])

    want = set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k, item in enumerate(items):
            for a in range(max(1, len(w) - len(item) + 1)) if w else ():
                x, y = counts(w[a : a + len(item)]), counts(item)
                both = sum((x & y).values())
                if both / (sum(x.values()) + sum(y.values()) - both) >= 0.8:
                    want.add((i, k))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, None), (91, "")], "item_id long, text string")
    found = decontam.contaminated(frame(spark, texts), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(found) == len(want)
    left = decontam.drop_contaminated(frame(spark, texts), bench)
    assert {r["doc_id"] for r in left.collect()} == set(range(len(texts))) - {i for i, _ in want}
    none = decontam.contaminated(frame(spark, texts), bench.where("false"))
    assert none.count() == 0


def test_embeddings(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(80, 16))
    x = np.concatenate([centres, centres[:30] + r.normal(scale=0.08, size=(30, 16)), centres[:1] + r.normal(scale=0.03, size=(150, 16))])
    x = np.concatenate([x, x[:5]]).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    n = len(x)
    want = components(n, lambda a, b: bool(near[a, b]))
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [0.0] * 15, [1.0, 2.0]]
    rows += [(n + k, v) for k, v in enumerate(odd)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i in range(n):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (int(near[i].sum()) - 1, want[i], want[i] == i)
    for k in range(len(odd)):
        assert (got[n + k]["n_links"], got[n + k]["component_id"], got[n + k]["kept"]) == (0, n + k, True)


def test_byte_bpe(spark):
    texts = odd_texts() + ["日本 😀 it's  fine\r\n", "a" * 3000, " " * 700, "!?" * 400]
    c = bpe.coder(VOCABULARY, PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    got = by_id(bpe.round_trip(frame(spark, texts), VOCABULARY, PATTERN).select("doc_id", "_code.*"))
    for i, t in enumerate(texts):
        assert got[i]["ids"] == own.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    digest = by_id(bpe.digests(frame(spark, texts), VOCABULARY, PATTERN).select("doc_id", "_code.*"))
    for i, t in enumerate(texts):
        ids = " ".join(map(str, own.encode_ordinary(t or "")))
        assert digest[i]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    two = bpe.decode(bpe.encode(frame(spark, texts), VOCABULARY, PATTERN), VOCABULARY, PATTERN)
    assert all(bytes(r["_bytes"]) == (r["text"] or "").encode() for r in two.collect())


def test_sharding(spark):
    texts = odd_texts()
    n = len(texts)
    got = by_id(sharding.assign_shards(frame(spark, texts)))
    for i, t in enumerate(texts):
        b = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(b) + 16, zlib.crc32(b))
        assert (got[i]["shard"], got[i]["slot"]) == sharding.place(got[i]["row_number"], n, 40)
    assert sorted(r["row_number"] for r in got.values()) == list(range(n))
    places = sharding.assign_shards(frame(spark, texts * 30, [5] * (30 * n)), shards=7).collect()
    for s in range(7):
        slots = sorted(r["slot"] for r in places if r["shard"] == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - 30 * n / 7) < 1


def test_language_held_out_accuracy(spark):
    df = contract.queries()["op1_language_id"](spark, DATA)
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = df.where("held_out").collect()
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in docs)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows]) > 0.95
    odd = language.predict_languages(frame(spark, odd_texts()), {"en": ["the of ant"], "xx": ["zzz yyy"]})
    got = {r["doc_id"]: r["_lang"] for r in odd.collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == got[9]["lang_pred"] == "und" and got[12]["lang_pred"] == "en"
    assert {r["_lang"]["lang_pred"] for r in language.predict_languages(frame(spark, ["a"]), {}).collect()} == {"und"}


def test_cross_parsing_counts_phrases():
    samples = {"a": ["banana bandana"], "b": ["abc cab"]}
    parser = language.CrossParser(samples)
    text = "bananas and cabs " * 60
    costs, letters = parser.costs(pa.array([text]))
    plain = " ".join(text.split()) + " "
    for k, name in enumerate(parser.names):
        sample, phrases = samples[name][0], 0
        for at in range(0, len(plain), language.BLOCK):
            block, i = plain[at : at + language.BLOCK], 0
            while i < len(block):
                j = i + 1
                while j <= len(block) and block[i:j] in sample:
                    j += 1
                phrases += 1
                i = max(i + 1, j - 1)
        assert math.isclose(costs[0, k], phrases * math.log2(len(sample)) / len(plain))
    assert letters.tolist() == [True]


def test_toxicity(spark):
    r = random.Random(6)
    plain = "the of ant bee cat dog elk fox gnu hen ibis jay koi".split()
    texts, rows = [None, ""], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        if i % 4 == 0:
            w[r.randrange(len(w))] = r.choice(["moron", "scum"])
        texts.append(" ".join(w))
        rows.append((i + 2, int(i % 4 == 0)))
    labels = spark.createDataFrame(rows[:400] + rows[:5] + [(0, None)], "doc_id long, toxic int")
    docs = frame(spark, texts)
    got = {x["doc_id"]: x["_score"] for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(texts)
    assert np.mean([(got[i] >= 0.5) == y for i, y in rows[400:]]) > 0.97
    unlabelled = toxicity.score(docs, toxicity.fit(docs, labels.where("false")))
    assert {x["_score"] for x in unlabelled.collect()} == {0.5}


PAGE = """<html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body class="page">
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy &amp; sell</div><article><h1>Head &quot;x&quot;</h1>
<p>First   <b>part</b>,<br>second &amp;amp; third.<div class="share-buttons">Share</div><p>A &lt; B</p>
<form><p>Mail</p></form><aside>Side</aside><section class="comments"><p>Nice post</p></section></article>
<footer>&copy; me</footer></body></html>"""


def test_html(spark):
    want = 'Head "x"\n\nFirst part, second &amp; third.\n\nA < B'
    plain = "<div class='menu'>a</div><div>" + "long text " * 20 + "</div><p>short</p><div><a href=x>more links</a></div>"
    pages = [None, "", "<p></p>", PAGE, plain, "<p>cut off <b", "<!-- x --><article><p>a"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    got = {r["page_id"]: r["_text"] for r in html.extract(df).collect()}
    assert got == {0: "", 1: "", 2: "", 3: want, 4: ("long text " * 20).strip() + "\n\nshort", 5: "cut off", 6: "a"}


@pytest.mark.parametrize("name", ["no-sidebar", "has-header", "page-with-sidebar", "main-search-result", "site sidebar"])
def test_html_wrappers_are_not_silenced(name):
    story = "A long story of many words that goes on for a while. " * 3
    for inner in (f"<article><p>{story}</p></article>", f"<p>{story}</p>"):
        page = f"<body><div class='{name}'>{inner}<div class='comments'><p>Nice</p></div></div><div class='menu'>Home</div>"
        assert html.main_text(page) == story.strip()


def test_html_article_tags_do_not_decide_alone():
    story = ["The first paragraph of the story has many words in it. " * 3, "The second one goes on with as many words. " * 3]
    body = "".join(f"<p>{p}</p>" for p in story)
    text = "\n\n".join(p.strip() for p in story)
    teasers = "".join(f"<article><h2><a href=/{i}>Teaser {i}</a></h2></article><hr>" for i in range(3))
    for page in (f"<div>{body}</div><div>{teasers}</div>", f"<article>Short box</article><div>{body}</div>"):
        assert text in html.main_text(page)
    linked = f"<p>{story[0]}</p><p><a href=x>a line that is all link</a></p><p>{story[1]}</p><p><a href=y>more</a></p>"
    assert html.main_text(linked) == f"{story[0].strip()}\n\na line that is all link\n\n{story[1].strip()}"


def test_words_are_lowered_runs():
    a, _ = words(pa.array(["The,CAT é"]))
    b, row = words(pa.array([None, "the", "cat", "é"]))
    assert a.tolist() == b.tolist() and row.tolist() == [1, 2, 3]


def test_empty_tables(spark):
    docs = frame(spark, ["x"]).where("false")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    for df in (
        substrings.remove_repeats(docs),
        lines.line_report(docs),
        lines.drop_repeated_lines(docs),
        simhash.near_duplicates(docs),
        simhash.keep_one_of_each(docs),
        decontam.contaminated(docs, bench),
        embeddings.near_duplicates(vectors),
        sharding.assign_shards(docs),
        bpe.round_trip(docs, VOCABULARY, PATTERN),
        language.predict_languages(docs, language.sample_texts(docs)),
        html.extract(docs, "text"),
    ):
        assert df.collect() == []


def test_null_and_repeated_ids(spark):
    texts = ["same text here for all of us", "same text here for all of us", "", None, "other words stand in this one"]
    docs = frame(spark, texts, [None, 3, 3, None, 3])
    assert substrings.remove_repeats(docs).count() == 5
    assert lines.line_report(docs).count() == 5
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 5 and {r["component_id"] for r in found if r["fp"] == found[0]["fp"]} <= {None, 3}
    assert sharding.assign_shards(docs).count() == 5


@pytest.mark.parametrize("name", ["op4_line_dedup", "op9_sharding"])
def test_queries_equal_sql(spark, name):
    assert difference(spark, connect(DATA), contract.queries()[name], contract.oracle_sql()[name], DATA) is None


def test_every_operator_is_registered():
    names = {int(re.match(r"op(\d+)_", n)[1]) for n in contract.queries() if re.match(r"op\d+_", n)}
    assert names == set(range(1, 14)) and "pipeline" in contract.queries()


def kept_by_similarity(rows):
    """The text of the smallest id of each group linked by five-word similarity of 0.8."""
    ids = sorted(rows)
    n = [max(1, len(rows[i].split()) - 4) for i in ids]
    near_in_size = lambda a, b: min(n[a], n[b]) >= 0.8 * max(n[a], n[b])
    at = components(len(ids), lambda a, b: near_in_size(a, b) and similarity(rows[ids[a]], rows[ids[b]]) >= 0.8 - 1e-12)
    return {ids[k]: rows[ids[k]] for k in set(at.values())}


def test_pipeline_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.selectExpr("*", "'x' AS _doc", "'y' AS _all", "1 AS fp").unionAll(
        spark.createDataFrame([(10**6, None, None, "s", 0, "x", "y", 1), (10**6 + 1, "12 !", "en", "s", 4, "x", "y", 1)], docs.schema.simpleString()[7:-1].replace(":", " ") + ", _doc string, _all string, fp int")
    )
    now, rows = extra, {r["doc_id"]: r["text"] for r in extra.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, DATA)
        got = {r["doc_id"]: r for r in out.collect()}
        if name == "language_id":
            rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            con = duckdb.connect()
            con.register("documents", pa.table({"doc_id": list(rows), "text": list(rows.values())}))
            kept = con.execute(lines.LINES_SQL + "SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') FROM marked GROUP BY 1")
            rows = dict(kept.fetchall())
        elif name == "simhash_near_dedup":
            rows = kept_by_similarity(rows)
        elif name == "benchmark_decontamination":
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            held = {i for i, t in rows.items() if any(x in " ".join(t.split()) for x in items)}
            assert held and not held & set(got)
            assert len(set(rows) - held - set(got)) <= 0.01 * len(rows)
            rows = {i: rows[i] for i in got}
        assert {i: r["text"] for i, r in got.items()} == rows, name
        if name != "byte_bpe":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            assert all(r["n_chars"] == len(r["text"]) for r in got.values()) or name == "language_id"
        now = out
    assert all(r["n_tokens"] == len(r["ids"]) for r in got.values())
    assert corpus_pipeline.run(spark, DATA).count() <= docs.count()


def test_pipeline_near_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    now = corpus_pipeline.line_dedup(spark, corpus_pipeline.language_id(spark, docs, DATA), DATA)
    rows = {r["doc_id"]: r["text"] for r in now.collect()}
    out = corpus_pipeline.near_dedup(spark, now, DATA)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    assert {r["doc_id"]: r["text"] for r in out.collect()} == kept_by_similarity(rows)
    left = corpus_pipeline.decontaminate(spark, out, DATA)
    coded = corpus_pipeline.tokenize(spark, left, DATA)
    assert {r["doc_id"]: r["text"] for r in coded.collect()} == {r["doc_id"]: r["text"] for r in left.collect()}
