import math
import random
import time
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from compare import SF
from gaugeframe.llm import decontaminate, licenses, mixing, quality, toxicity, url_filter
from gaugeframe.llm.tokens import hash_ranges, shingle_sets, words

DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int, quality int"


# ---- the text kernel -----------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB \t\n\x0b\x85é", max_size=30), min_size=1, max_size=6))
def test_shingle_sets(texts):
    raw = [t.encode() for t in texts]
    grams, n = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])], 3)
    assert n.tolist() == [len(brute.shingles(t, 3)) for t in texts]
    cut = np.split(grams, np.cumsum(n)[:-1])
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            assert len(np.intersect1d(cut[i], cut[j])) == len(brute.shingles(x, 3) & brute.shingles(y, 3))


def test_equal_ranges_hash_alike():
    buf = np.frombuffer(b"abcabc" * 5000, np.uint8)
    s = np.arange(0, 29000, 3)
    assert len(np.unique(hash_ranges(buf, s, s + 300))) == 1
    assert len(words(np.frombuffer(b" a bc", np.uint8), np.array([0, 5]))[0]) == 2


# ---- 2 -------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    cases = {
        "https://Example.COM/en/7x?q#f": ("example.com", "/en/7x", "example.com/en/7", "allow"),
        "http://a.example.com/en/8": ("a.example.com", "/en/8", "com/en/", "block"),
        "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
        "x://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "x://w.net/de/": ("w.net", "/de/", "net/de/", "allow"),
        "x://a.org/es/1": ("a.org", "/es/1", "org/es/", "block"),
        "x://a.org/ES/1": ("a.org", "/ES/1", None, "allow"),
        "x://a.org": ("a.org", "", None, "allow"),
        "x://a.org?y/es/": ("a.org", "", None, "allow"),
        "x://a.org#://b": ("a.org", "", None, "allow"),
        "ÄB://ÄB.org/p\nq?x": ("ÄÄ".replace("ÄÄ", "Ä") + "b.org", "/p\nq", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_templates(spark):
    """On a host whose labelled urls are blocked, an unlabelled one of the same template goes with them."""
    rules = [("block", "h.com", "/bad/1"), ("allow", "h.com", "/good/1")]
    urls = [f"x://h.com/bad/1{i}" for i in range(40)] + [f"x://h.com/good/1{i}" for i in range(40)] + ["x://h.com/bad/2", "x://h.com/good/2", "x://other.com/bad/2", "x://h.com/bad/2"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(df, rules).collect()}
    assert [got[i] for i in (80, 81, 82, 83)] == ["block", "allow", "allow", "block"] and len(got) == 84


def test_smoothed_purity_by_hand(spark):
    """Shares of a path, from all urls down: each node is smoothed by the one above."""
    rules = [("block", "h.com", "/a/x"), ("allow", "h.com", "/a/y"), ("block", "g.com", "/b/x")]
    urls = ["x://h.com/a/x"] * 12 + ["x://h.com/a/y"] * 4 + ["x://g.com/b/x"] * 30 + ["x://h.com/a/z", "x://h.com/c", "x://g.com/b/z", "x://g.com/c", "x://k.com/c"]
    rate = 42 / 51
    smooth = lambda b, m, up: (b + 4 * up) / (m + 4)
    h, g = smooth(12, 16, rate), smooth(30, 30, rate)
    # h.com: the parent's share, the host's; and the same of g.com
    assert smooth(12, 16, h) < 0.8 and h < 0.8 and smooth(30, 30, g) >= 0.8 and g >= 0.8 and rate >= 0.8
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["verdict"] for r in url_filter.filter_urls(df, rules).orderBy("page_id").collect()]
    assert got[46:] == ["allow", "allow", "block", "block", "block"]  # g.com by its own share, k.com by that of all urls


def test_block_rules_alone_leave_other_hosts_alone(spark):
    """Examples of one kind only don't make every url look like them."""
    urls = ["x://bad.com/p/1"] * 20 + [f"x://h{i % 7}.com/a/{i}" for i in range(80)] + ["x://bad.com/q", "x://h1.com/p/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["verdict"] for r in url_filter.filter_urls(df, [("block", "bad.com", "/p/"), ("block", "h1.com", "/p/")]).orderBy("page_id").collect()]
    assert got[:20] == ["block"] * 20 and got[20:100] == ["allow"] * 80 and got[100:] == ["block", "block"]


def test_url_templates_of_any_depth(spark):
    """Variable nodes and merged branches five levels down, against SQL."""
    import duckdb

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rules = [("block", "h.com", "/a/b/c/bad/"), ("allow", "h.com", "/a/b/c/good/"), ("block", "g.com", "/x/y/p/z"), ("block", "g.com", "/x/y/q/z"), ("allow", "g.com", "/x/y/r/w/")]
    urls = [f"x://h.com/a/b/c/{rng.choice(['bad', 'good'])}/{word()}/end" for _ in range(120)] + [f"x://h.com/a/b/c/bad/{word()}" for _ in range(5)]
    urls += [f"x://g.com/x/y/{rng.choice('pqr')}/{rng.choice(['z', 'w'])}/{rng.choice('klm')}" for _ in range(200)]
    urls += [f"x://h.com/a/b/c/d/e/f/{word()}/{word()}" for _ in range(60)] + ["x://h.com/a//b/", "x://h.com/a/b/c/bad", "x://h.com", None, "x://g.com/x/y/2021/z"] * 2
    rows = list(enumerate(urls)) + [(None, urls[0])]
    got = [tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [list(r) for r in rows])
    want = con.execute(url_filter.oracle(rules)).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    seen = {r[0]: r[5] for r in got}
    assert seen[0].startswith(("a/b/c/bad/*/", "a/b/c/good/*/")) and seen[325] == "a/b/c/d/e/f/*/*"
    assert len(set(seen.values())) < 40


# ---- 3 and 4 -------------------------------------------------------------------------------------------------


def accuracy(spark, result, column, sf):
    lab = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["predicted"], lab[r["doc_id"]]) for r in result.where("held_out").collect() if lab.get(r["doc_id"]) is not None]
    return sum(p == y for p, y in rows) / len(rows), len(rows)


def test_quality_on_held_out_rows(spark):
    from gaugeframe.llm.queries import op3_quality

    sf = "/root/testdata/sf0.1"
    got, n = accuracy(spark, op3_quality(spark, sf), "quality", sf)
    assert n > 500 and got > 0.97


def test_toxicity_on_held_out_rows(spark):
    from gaugeframe.llm.queries import op4_toxicity

    sf = "/root/testdata/sf0.1"
    got, n = accuracy(spark, op4_toxicity(spark, sf), "toxic", sf)
    assert n > 500 and got > 0.97


def test_word_vectors_against_plain_sums(spark):
    """Context sums and pooled features of a few texts, word by word."""
    rng = random.Random(8)
    texts = ["", "one", "aa bb aa", "É!! x--y z2 ??"] + [" ".join(rng.choice(["ab", "Ab", "cd!", "e", "...", "fé"]) for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    got = quality.context_sums(spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3), spark)
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x20\t-\r]+")
    row = lambda w: int(quality.rows_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    place, sign = quality.index_vectors()
    want = np.zeros((quality.V, quality.D))
    rows = [[row(w) for w in token.findall(t.encode())] for t in texts]
    for r in rows:
        for i, a in enumerate(r):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(r):
                    for k in range(quality.NONZERO):
                        want[a, place[r[j], k]] += sign[r[j], k]
    assert np.allclose(got, want)
    vec, signs = quality.word_vectors(got), quality.sign_vectors()
    raw = [t.encode() for t in texts]
    x = quality.pooled(vec, signs, np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    for r, f in zip(rows, x):
        plain = np.zeros(quality.WIDTH)
        if r:
            plain[: quality.D] = np.mean([vec[a] for a in r], axis=0)
            plain[quality.D] = np.linalg.norm(np.mean([signs[a] for a in r], axis=0)) / np.sqrt(quality.SIGNS)
            plain[quality.D + 1 :] = sum(a == b for a, b in zip(r, r[1:])) / len(r), np.log1p(len(r))
        assert np.allclose(f, plain, atol=1e-5)


def test_network_gradients_learn_and_calibrate():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(400, quality.WIDTH - 1)), np.full(400, 3.0)])
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    net = quality.train(x, y, np.ones(400))
    p = 1 / (1 + np.exp(-quality.logits(net, quality.shrunk(x, net["base"]))))
    assert ((p > 0.5) == y).mean() > 0.9 and 0.2 <= net["t"] <= 8.1


def plain_features(model, text):
    """The features of one text, each word held against each term."""
    low = bytes(toxicity.fold(np.frombuffer(text.encode(), np.uint8)))
    found = [m for m in re.finditer(rb"[a-z0-9\x80-\xff]+", low)]
    hits = []
    for i, m in enumerate(found):
        w = m.group()
        near = [(0, t) for t, x in enumerate(model["words"]) if x == w] or [(1, t) for t, x in enumerate(model["words"]) if len(x) >= toxicity.FUZZY_BYTES and abs(len(x) - len(w)) <= 1 and brute.distance(x, w) == 1]
        stem = [t for t, x in enumerate(model["stems"]) if w.startswith(x)]
        if near and (near[0][0] == 0 or w not in model["own_words"]):
            hits.append((i, near[0][0], model["word_odds"][min(near)[1]]))
        elif stem:
            hits.append((i, 2, model["stem_odds"][stem[0]]))
    sums = np.zeros(3)
    for k, (i, kind, odds) in enumerate(hits):
        around = sum(1 for j in (k - 1, k + 1) if 0 <= j < len(hits) and abs(found[hits[j][0]].start() - found[i].start()) <= toxicity.WINDOW_BYTES)
        sums[kind] += odds / 4 * toxicity.context_weight(np.frombuffer(low, np.uint8), 0, len(low), found[i].start(), found[i].end(), around)
    total = sums.sum()
    return np.r_[np.log1p(sums), np.log1p(100 * total / max(len(found), 20)), min(total, 1), total > 0]


def test_toxicity_against_plain_matching(spark):
    """Scores of documents by the automaton and by holding every word against every term."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), spark)
    assert model["words"] or model["stems"]
    rows = [r for r in docs.orderBy("doc_id").limit(150).collect() if r["text"]]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, docs.schema), model, spark).collect()}
    for r in rows:
        z = plain_features(model, r["text"]) @ model["beta"][:-1] + model["beta"][-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


@pytest.mark.parametrize("module, fold, keep", [(quality, 4, 2), (toxicity, 3, 1)])
def test_classifiers_on_odd_rows(spark, module, fold, keep):
    rng = random.Random(1)
    text = lambda bad: " ".join((["foulword", "### %%%"] if bad else []) + [f"w{rng.randrange(300)}" for _ in range(30)])
    rows = [(i, text(i % 3 == 0), 9) for i in range(240)] + [(1000, None, 1), (1001, "", 2), (None, "x", 3), (1, text(False), 4), (1, text(False), 4), (1002, "y " * 200_000, 5)]
    labels = [(i, int(i % 3 == 0), int(i % 3 != 0)) for i in range(240)] + [(None, 1, 0), (5, None, None), (1000, 0, 1)]
    docs, lab = spark.createDataFrame(rows, DOCS + ", score int"), spark.createDataFrame(labels, LABELS)
    got = module.classify(docs, lab, spark).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = {r["doc_id"]: r["held_out"] for r in got if r["doc_id"] is not None}
    assert all(h == (zlib.crc32(str(i).encode()) % fold == keep) for i, h in held.items())
    hits = [(r["predicted"], (r["doc_id"] % 3 == 0) == (module is toxicity)) for r in got if r["doc_id"] is not None and 5 < r["doc_id"] < 240]
    assert sum(p == y for p, y in hits) > 0.9 * len(hits)
    assert module.classify(docs.limit(0), lab, spark).count() == 0
    assert module.classify(docs, lab.limit(0), spark).count() == len(rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=4, unique=True), st.lists(st.text("abcd", min_size=1, max_size=8), min_size=1, max_size=12))
def test_levenshtein_automaton(terms, tokens):
    """The table accepts what is within one edit of a term of five bytes, and shorter terms as they are."""
    raw = [t.encode() for t in terms]
    table, term, edits = toxicity.fuzzy_table(raw)
    joined = np.frombuffer("".join(tokens).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    at, state = toxicity.walk(table, toxicity.classes(raw)[0], joined, ends - [len(t) for t in tokens], ends)
    found = {int(i): int(edits[s]) for i, s in zip(at, state) if term[s] >= 0}
    for i, t in enumerate(tokens):
        d = min((brute.distance(t.encode(), r) for r in raw if len(r) >= 5 or t.encode() == r), default=9)
        assert found.get(i, 9) == (d if d <= 1 else 9)


def test_context_tells_quotation_from_abuse():
    def weight(text, word="idiot"):
        low = np.frombuffer(text.lower().encode(), np.uint8)
        s = text.lower().encode().index(word.encode())
        return toxicity.context_weight(low, 0, len(low), s, s + len(word), 0)

    assert weight('The critics "shouted idiot at night" here.') == toxicity.QUOTED
    assert weight("The word idiot is old.") == toxicity.QUOTED
    assert weight("You are an idiot, really.") == toxicity.DIRECTED
    assert weight("Some idiot parked there.") == 1.0


def test_misspelled_terms_score(spark):
    rng = random.Random(2)
    words_ = lambda: [f"w{rng.randrange(200)}" for _ in range(40)]
    rows = [(" ".join([*words_(), *(["scoundrel", "numbskull"] if i % 2 else [])]), i % 2) for i in range(200)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, y int"), 0.5, spark)
    score = lambda t: float(1 / (1 + np.exp(-(toxicity.features(model, b := np.frombuffer(t.encode(), np.uint8), np.array([0, len(b)]))[0] @ model["beta"][:-1] + model["beta"][-1]))))
    clean = " ".join(words_())
    assert score(clean) < 0.3 and score(clean + " scoundrel numbskull") > 0.7 and score(clean + " SCOUNDREL! nunbskull") > 0.6


def test_long_words_of_toxic_texts(spark):
    """A run of some thousand bytes without a space can be a term; the table is as large as its terms ask for."""
    run = "骂" * 500 + "，" + "人" * 300
    rows = [(f"w{i} {run} v{i}" if i % 2 else f"w{i} clean v{i}", i % 2) for i in range(60)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, y int"), 0.5, spark)
    assert run.encode() in model["words"] and model["table"].shape[1] < 64
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(rows)], LABELS)
    assert toxicity.classify(docs, labels, spark).count() == 60


# ---- 5 -------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(2, 5), min_size=1, max_size=12), min_size=1, max_size=4), st.lists(st.integers(2, 5), min_size=1, max_size=9))
def test_alignment(windows, item):
    left = np.zeros((len(windows), max(map(len, windows))), np.uint64)
    for i, w in enumerate(windows):
        left[i, : len(w)] = w
    right = np.tile(np.array([*item, 1, 1], np.uint64), (len(windows), 1))
    assert decontaminate.align(left, right).tolist() == [brute.smith_waterman(w, item) for w in windows]


def test_decontamination(spark):
    rng = random.Random(3)
    w = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    item = w(40)
    edited = [x for i, x in enumerate(item) if i % 9 != 4]
    edited[10] = "changed"
    docs = [
        (1, " ".join(w(200))),
        (2, " ".join(w(80) + item + w(80))),
        (3, " ".join(w(30) + edited + w(500))),
        (4, " ".join(w(10) + [x.upper() + "," for x in item])),
        (5, " ".join(w(50) + item[:6] + w(50))),
        (6, None),
        (7, ""),
        (8, "tiny item"),
        (9, "tiny  ITEM here"),
        (2, " ".join(w(80) + item)),
        (10, " ".join(w(5000) + item + w(5000))),
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "tiny item"), (5, " ".join(item)), (6, " ".join(w(30)))], "item_id long, text string")
    df = spark.createDataFrame(docs, DOCS)
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench, spark).collect())
    assert got == sorted([(d, i) for d in (2, 2, 3, 4, 10) for i in (1, 5)] + [(8, 4), (9, 4)])
    extra = spark.createDataFrame([(*d, "s") for d in docs], DOCS + ", item_id string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(extra, bench, spark).collect()) == [1, 5, 6, 7]
    assert decontaminate.find(df, bench.limit(0), spark).count() == 0 and decontaminate.find(df.limit(0), bench, spark).count() == 0


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([2, 6, 12, 30])))) for i in range(14)]
    docs = []
    for d in range(60):
        own = text(rng.randrange(5, 60))
        if d % 3:
            copy = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                j = rng.randrange(len(copy))
                copy[j : j + rng.randrange(2)] = rng.choice([[], ["new"], ["new", "one"]])
                copy = copy or ["w"]
            at = rng.randrange(len(own))
            own[at:at] = copy
        docs.append((d, " ".join(rng.choice(["", "(((((("]) + w + rng.choice(["", ".....", "!"]) for w in own)))
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), spark).collect()}
    want = brute.find(docs, items)
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(want) > 30
    assert all(s <= next(w for d, i, w in want if (d, i) == (doc, item)) for doc, item, s in got)


def test_punctuation_of_any_length_is_dropped():
    h = lambda t: decontaminate.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0].tolist()
    assert h("word") == h("((((((word.......") == h("  ...... Word,") and h("....... ((((((") == [] and h("a-b") != h("ab")


def test_windows_are_aligned_by_area():
    width, deep = np.array([10, 300_000, 20, 15, 90_000, 12]), np.array([5, 10, 5, 5, 100_000, 5])
    parts = [p.tolist() for p in decontaminate.by_area(width, deep)]
    assert sorted(x for p in parts for x in p) == list(range(6)) and [1] in parts and [4] in parts


def test_rare_seeds(spark):
    """Of an item's n-grams that occur the cheaper half are seeds, and others that cost little more."""
    grams = spark.createDataFrame([(1, x, i) for i, x in enumerate([10, 11, 12, 13])] + [(2, x, i) for i, x in enumerate([13, 14])] + [(3, 13, 0), (4, 99, 0)], "item long, term long, place int")
    found = spark.createDataFrame([(x,) for x, n in ((10, 1), (11, 2), (12, 33), (13, 20)) for _ in range(n)], "term long")
    got = sorted(tuple(r) for r in decontaminate.rare_seeds(grams, found).select("item", "term", "place").collect())
    # item 1: costs 1, 2, 33 and 3 * 20, of which 33 is over 16 times the second; 14 and 99 don't occur
    assert got == [(1, 10, 0), (1, 11, 1), (2, 13, 0), (3, 13, 0)]


def test_one_phrase_in_many_items_and_one_text(spark):
    """Items that share a phrase with a text which repeats it are ruled out at once; what a text holds of them is found."""
    rng = random.Random(5)
    phrase = "as far as we know".split()
    items = [(i, [f"i{i}x{j}" for j in range(15)] + phrase + [f"i{i}y{j}" for j in range(15)]) for i in range(4000)]
    text = []
    for _ in range(100):
        text += phrase + [f"t{rng.randrange(5000)}" for _ in range(70)]
    h = lambda ws: decontaminate.word_hashes(np.frombuffer(" ".join(ws).encode(), np.uint8), np.array([0, len(" ".join(ws))]))[0]
    starts = np.flatnonzero([text[i : i + 5] == phrase for i in range(len(text))]) - 15
    began = time.time()
    assert not any(decontaminate.scores_of(h(text), [(h(ws), starts) for _, ws in items]))
    assert time.time() - began < 3  # 4,000 items and 100 places each; most of it is hashing the items
    df = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(text[:200] + items[77][1] + text[200:400]))], DOCS)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items[:300]], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find(df, bench, spark).collect()] == [(2, 77, 70)]


def test_copies_of_one_text(spark):
    """All rows of a text that holds an item are reported, and go."""
    docs = [(i, "x y z a b c d e f g h i j") for i in range(200)] + [(None, "x y z a b c d e f g h i j"), (900, "other words only")]
    bench = spark.createDataFrame([(1, "a b c d e f g h i j"), (None, "other words only")], "item_id long, text string")
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], DOCS + ", T1 int, `t2.x` int")
    assert sorted((r["doc_id"] is None, r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench, spark).collect()) == sorted((d is None, d, 1) for d, _ in docs[:201])
    left = decontaminate.clean(df, bench, spark)
    assert left.columns == df.columns and [tuple(r) for r in left.collect()] == [(900, "other words only", 1, 2)]


@pytest.mark.parametrize("exact", [False, True])
def test_decontamination_of_edited_copies(spark, exact):
    """One word of each stretch of eight is replaced, at each offset; with and without an exact copy elsewhere."""
    rng = random.Random(7)
    items = {1: [f"a{i}" for i in range(10)], 2: [f"b{i}" for i in range(40)]}
    docs = {}
    for item, words_ in items.items():
        for offset in range(8):
            copy = ["changed" if i % 8 == offset else x for i, x in enumerate(words_)]
            docs[item * 100 + offset] = [f"c{rng.randrange(500)}" for _ in range(30)] + copy + [f"c{rng.randrange(500)}" for _ in range(30)]
        if exact:
            docs[item * 100 + 50] = words_
    want = {(d, d // 100, brute.smith_waterman(x, items[d // 100])) for d, x in docs.items()}
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in docs.items()], DOCS)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.find(df, bench, spark).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean(df, bench, spark).collect()} == set()


# ---- 6 -------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abcdef", min_size=1, max_size=2), st.tuples(st.integers(1, 60), st.floats(0.01, 1)), min_size=1, max_size=6))
def test_pfair(sources):
    """Every block once; in each phase each source is within one block of its share at each slot."""
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    assert placed(mixing.phases(blocks, weights), weights) == blocks


def placed(plan, weights):
    """Blocks by source of a plan in which each source is within one block of its given weight at every slot of its phase."""
    used: dict[int, str] = {}
    count: dict[str, int] = {}
    for p in plan:
        total = sum(Fraction(weights[s]) for s in p["at"])
        share = {s: Fraction(weights[s]) / total for s in p["at"]}
        end = 0
        for s, at in p["at"].items():
            assert p["first"][s] == count.get(s, 0)
            count[s] = count.get(s, 0) + len(at)
            for j, t in enumerate(at):
                assert p["slot"] + t not in used and int(j / share[s]) <= t < -((-j - 1) // share[s])
                used[p["slot"] + t] = s
            end = max(end, *[t + 1 for t in at], 0) if at else end
        seen = dict.fromkeys(share, 0)
        for t in range(end):
            seen[used[p["slot"] + t]] += 1
            assert all(abs(k - (t + 1) * share[s]) < 1 for s, k in seen.items())
    assert sorted(used) == list(range(len(used)))
    return count


def test_pfair_keeps_to_the_given_weights():
    """Weights that no small whole numbers give, over 10^5 slots."""
    weights = {"a": 1 / 3, "b": 0.33334, "c": 0.3331, "d": 0.0001, "e": 1e-7}
    blocks = {"a": 34_000, "b": 34_000, "c": 34_000, "d": 11, "e": 1}
    plan = mixing.phases(blocks, weights)
    assert len(plan[0]["at"]["a"]) + len(plan[0]["at"]["b"]) > 60_000
    first = plan[0]
    total = sum(weights.values())
    for s, at in first["at"].items():
        w = weights[s] / total
        assert all(j / w - 1 - 1e-6 < t < (j + 1) / w + 1 + 1e-6 for j, t in enumerate(at))
    assert placed([p for p in mixing.phases({"a": 900, "b": 901, "c": 700, "d": 2}, weights)], weights) == {"a": 900, "b": 901, "c": 700, "d": 2}
    with pytest.raises(ValueError):
        mixing.phases({"a": 1}, {"a": 0.0})


def brute_mix(rows, weights, size):
    """Slots of (source, block): at each slot the released block that is due first."""
    left = {s: -(-sum(r[1] == s for r in rows) // size) for s in {r[1] for r in rows}}
    done, out, start = dict.fromkeys(left, 0), {}, 0
    while any(left.values()):
        live = [s for s in left if left[s]]
        w = {s: Fraction(weights[s]) / sum(Fraction(weights[x]) for x in live) for s in live}
        put, t = dict.fromkeys(live, 0), 0
        while all(put[s] < left[s] for s in live):
            due, s = min((-((-put[s] - 1) // w[s]), s) for s in live if put[s] / w[s] < t + 1)
            out[s, done[s] + put[s]] = start + t
            put[s] += 1
            t += 1
        for s in live:
            done[s] += put[s]
            left[s] -= put[s]
        start += t
    return out


def test_mixing(spark):
    rows = [(i, "a" if i % 3 else ("b" if i % 2 else None), i, "x", i, "y", 2.0) for i in range(500)] + [(1, "a", 0, "x", 0, "y", 2.0)] * 2 + [(None, "c", 1, None, 1, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot int, mix_block string, _source int, `at` string, `row` double")
    got = mixing.mix(df, spark, block_rows=8).collect()
    assert got[0].asDict().keys() == {"doc_id", "source", "_source", "at", "row", "mix_phase", "mix_block", "mix_slot", "mix_position"}
    assert len(got) == len(rows) and len({r["mix_position"] for r in got}) == len(rows)
    assert sorted(((r["doc_id"], r["source"], r["_source"], r["at"], r["row"]) for r in got), key=repr) == sorted(((r[0], r[1], r[4], r[5], r[6]) for r in rows), key=repr)
    named = [(r[0], r[1] or "") for r in rows]
    counts = {s: sum(x == s for _, x in named) for s in {x for _, x in named}}
    want = brute_mix(named, mixing.target_weights(counts), 8)
    assert {(r["source"] or "", r["mix_block"]): r["mix_slot"] for r in got} == want
    for s in ("a", "b", None, "c"):
        ranks = sorted((r["mix_position"], r["mix_block"]) for r in got if r["source"] == s)
        assert [b for _, b in ranks] == sorted(b for _, b in ranks)
        assert all(sum(r["source"] == s and r["mix_block"] == b for r in got) == 8 for b in range(max(x for _, x in ranks)))
    assert sorted(map(tuple, mixing.mix(df.repartition(3), spark, block_rows=8).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(df.limit(0), spark).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, spark, weights={"a": 1.0})


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 10)
    df = spark.range(1000).selectExpr("id as doc_id", "if(id % 4 = 0, 'a', 'b') as source")
    got = mixing.mix(df, spark).collect()
    assert len({r["mix_position"] for r in got}) == 1000 and len({(r["source"], r["mix_block"]) for r in got}) <= 12


# ---- 10 ------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    texts = licenses.known_texts()
    assert len(texts) >= 20 and all(len(texts[n]) > 10_000 for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0"))
    mit, bsd = texts["MIT"].partition("\n\n")[2], texts["BSD-3-Clause"]
    wrapped = bsd.replace("above copyright notice", "above\ncopyright notice")
    rows = [
        (1, mit),
        (2, "MIT License\n\nCopyright (c) 2020 Someone\n\n  " + mit.upper().replace("SUBLICENSE", "sublicence").replace("\n", "\n\n  ")),
        (3, "/* " + mit.replace('"', "\'\'") + " */"),
        (4, mit + " and more"),
        (5, "words\nReleased under the MIT Licence\nwords\nLicensed under CC BY-NC 4.0."),
        (6, "LICENSED UNDER CC BY-NC 4.0"),
        (7, None),
        (8, ""),
        (9, "x " * 100_000),
        (10, "BSD 3-Clause License\n\nCopyright 2019, Them\nAll rights reserved.\n\n" + wrapped),
        (11, texts["GPL-3.0"].replace("\n", "\r\n")),
        (12, texts["Apache-2.0"].partition("END OF TERMS")[0]),
        (13, "© 2001 Wir\n" + texts["ISC"]),
    ]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in licenses.scan(spark.createDataFrame([(*r, "y", "z") for r in rows], DOCS + ", license string, canonical_sha256 string"), spark).collect()}
    cc = "CC-BY-NC-4.0-notice"
    want = {1: "MIT", 2: "MIT", 3: "MIT", 6: cc, 10: "BSD-3-Clause", 11: "GPL-3.0", 12: "Apache-2.0", 13: "ISC"}
    assert {i: n for i, (n, _) in got.items()} == {i: want.get(i) for i, _ in rows}
    assert {i: n for i, (_, n) in got.items() if n} == {5: f"{cc},MIT-notice", 6: cc}
    assert licenses.scan(spark.createDataFrame([], DOCS), spark).count() == 0


def test_canonical_form_keeps_letters_of_all_scripts():
    c = licenses.canonical
    assert c("Лицензия 2") == "лицензия 2" and c("許可証、第2条") == "許可証 第2条" and c("ÄRGER_x") == "ärger x"
    assert c("licence licence") == "license license" and c("a\nCopyright (c) X\nb") == "a b" and c("the\ncopyright notice") == "the copyright notice"
    assert len({h for h, _ in licenses.known_digests()}) == len(licenses.known_digests())


def test_licences_with_other_words_and_holders():
    texts = licenses.known_texts()
    known = dict(licenses.known_digests())
    name = lambda x: known.get(licenses.sha(licenses.canonical(x)))
    mit, bsd = texts["MIT"], texts["BSD-3-Clause"]
    for line in ("Copyright 2020 Jane Doe", "Copyright Jane Doe, 2020", "Copyright The X Authors.", "Copyright (c) X", "(c) 1999 Y. All rights reserved."):
        assert name(line + "\n\n" + mit) == "MIT"
    assert name(mit.replace("sublicense", "sub-license")) == "MIT"
    assert "copyright holder" in bsd.lower()
    for holder in ("Acme Corp.", "the University of X, Berkeley", "the copyright owner"):
        other = re.sub("(?i)neither the name of the copyright holder", f"Neither the name of {holder}", " ".join(bsd.split()))
        assert other != " ".join(bsd.split()) and name(other) == "BSD-3-Clause"
    assert name(texts["Apache-2.0"].replace("authorized", "authorised").replace("copyright owner", "copyright holder")) == "Apache-2.0"
    assert name(mit.replace("without restriction", "with restriction")) is None and name(bsd.replace("Neither", "Either")) is None
    ids = [d for d, _ in licenses.known_digests()]
    assert len(ids) == len(set(ids))


def test_native_operators_run_no_python(spark):
    from gaugeframe.llm.queries import QUERIES

    for name in ("op2_url_filter", "op6_mixing"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_terms_that_tell_are_those_of_plain_counts(spark):
    """toxicity.learn's words, misspellings seen in clean texts and stems, counted by hand over the contexts of each label."""
    rng = random.Random(21)
    plain_words = [f"{a}{b}" for a in ("ner", "tol", "mip", "sav") for b in ("an", "eld", "ito", "usk", "orr")]
    bad = ["grobnak", "SNARVIL", "vexxod"]
    rows = []
    for i in range(120):
        y = i % 3 == 0
        ws = [rng.choice(plain_words) for _ in range(rng.randrange(4, 14))]
        for _ in range(rng.randrange(1, 4) if y else i % 20 == 1):
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(bad) + rng.choice(["", "", "ig", "ou"]))
        if not y and i % 10 == 4:
            ws.append("grobnac")  # one edit away, in clean texts
        rows.append((i, " ".join(ws) + rng.choice(["", "!", ". "]), int(y)))
    n = (sum(1 for r in rows if not r[2]), sum(1 for r in rows if r[2]))
    contexts = {}
    for _, text, y in rows:
        runs = re.findall(rb"[a-z0-9\x80-\xff]+", text.lower().encode())
        for j, w in enumerate(runs):
            contexts.setdefault(w, set()).add((y, runs[j - 1] if j else None, runs[j + 1] if j + 1 < len(runs) else None))
    counts = {w: (sum(y for y, *_ in c), sum(1 - y for y, *_ in c)) for w, c in contexts.items()}
    odds = lambda t, c: math.log((t + 0.5) / (n[1] + 1)) - math.log((c + 0.5) / (n[0] + 1))
    want = {w: odds(t, c) for w, (t, c) in counts.items() if len(w) >= 3 and t >= toxicity.SUPPORT and odds(t, c) >= toxicity.WORD_ODDS}
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, y int"), n[1] / len(rows), spark)
    assert model["words"] == sorted(want) and b"grobnak" in want
    assert model["word_odds"] == pytest.approx([want[w] for w in sorted(want)])
    assert b"grobnac" in model["own_words"] and not model["own_words"] & set(want)
    begins = {}
    for w, (t, c) in counts.items():
        if w not in want:
            for k in range(toxicity.STEMS[0], min(len(w), toxicity.STEMS[-1]) + 1):
                a, b = begins.get(w[:k], (0, 0))
                begins[w[:k]] = (a + t, b + c)
    stems = {}
    for s, (t, c) in sorted(begins.items(), key=lambda x: (len(x[0]), x[0])):
        if t >= toxicity.SUPPORT and odds(t, c) >= toxicity.STEM_ODDS and not any(s[:k] in stems for k in range(1, len(s))):
            stems[s] = odds(t, c)
    assert model["stems"] == sorted(stems) and (not stems or model["stem_odds"] == pytest.approx([stems[s] for s in sorted(stems)]))


def test_gradients_of_the_quality_network(monkeypatch):
    """The first step goes against the sign of each derivative; these are taken by differences of the loss."""
    monkeypatch.setattr(quality, "STEPS", 1)
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(60, 5)), np.log1p(rng.integers(1, 400, 60))])
    y, w = (rng.random(60) < 0.4).astype(float), rng.random(60) + 0.1
    net = quality.train(x, y, w)
    base = (x[:, :-1] * w[:, None]).sum(axis=0) / w.sum()
    z = quality.shrunk(x, base)
    z = (z - z.mean(axis=0)) / (z.std(axis=0) + 1e-6)
    fit = np.arange(60) % 5 != 0
    z, y, w = z[fit], y[fit], w[fit] / w[fit].sum()
    start = np.random.default_rng(7)
    p = {"a": start.normal(0, 1 / np.sqrt(6), (6, quality.HIDDEN)), "b": np.zeros(quality.HIDDEN), "c": start.normal(0, 1 / np.sqrt(quality.HIDDEN), quality.HIDDEN), "d": np.zeros(1)}

    def loss(p):
        out = np.tanh(z @ p["a"] + p["b"]) @ p["c"] + p["d"]
        return (w * np.logaddexp(0, np.where(y == 1, -out, out))).sum() + quality.DECAY / 20 * ((p["a"] ** 2).sum() + (p["c"] ** 2).sum())

    seen = 0
    for k in p:
        for at in np.ndindex(p[k].shape):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            if abs(slope) > 1e-6:
                assert net[k][at] - p[k][at] == pytest.approx(-quality.RATE * np.sign(slope), rel=1e-2)
                seen += 1
    assert seen > 150


def test_temperature_is_the_one_with_the_least_held_loss():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(300, 4)), np.log1p(rng.integers(1, 400, 300))])
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    w = np.ones(300)
    net = quality.train(x, y, w)
    held = np.arange(300) % 5 == 0
    z = quality.shrunk(x, net["base"])[held]
    loss = lambda t: np.logaddexp(0, np.where(y[held] == 1, -1, 1) * quality.logits(net | {"t": t}, z)).sum()
    grid = np.geomspace(0.25, 8, 60)
    assert net["t"] in grid and loss(net["t"]) == pytest.approx(min(map(loss, grid)))
