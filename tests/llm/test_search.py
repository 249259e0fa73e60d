import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeframe.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [x.translate(FOLD) for x in TERM.findall(text or "")]


def brute(docs, items, top=10):
    """(item_id, rank, doc_id, score), every document scored for every item."""
    have = [(d, Counter(terms(t))) for d, t in docs]
    long = [sum(c.values()) for _, c in have]
    n, total = sum(x > 0 for x in long), sum(long)
    df = Counter(t for _, c in have for t in c)
    out = []
    for item, text in sorted({x for x in items if x[0] is not None and x[1] is not None}):
        scored = []
        for (d, c), size in zip(have, long):
            if d is None or not size:
                continue
            m = 25 + 75 * size * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in Counter(terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, d))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted(tuple(r) for r in search.rank(d, i, spark, **kw).select("item_id", "rank", "doc_id", "score").collect())


WORDS = ["ant", "Bee", "cat", "dog", "éa", "7", "the"]


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    return [(int(k), " ".join(rng.choice(WORDS, rng.integers(1, 12)))) for k in range(n)]


@pytest.mark.parametrize("shard", [1, 40, 1 << 20])
def test_equal_to_scoring_every_document(spark, shard):
    docs, items = corpus(1, 300), [(1, "ant bee"), (2, "the the dog Cat"), (3, "éa 7"), (4, "nowhere"), (5, "the")]
    assert run(spark, docs, items, shard=shard) == brute(docs, items)


def test_blocks_of_items_change_nothing(spark):
    docs, items = corpus(2, 80), [(k, t) for k, t in corpus(3, 25)]
    assert run(spark, docs, items, block=9, top=3) == brute(docs, items, 3)


def test_odd_rows(spark):
    """Nulls, empty and punctuation-only texts, ties, repeated rows and ids, a long text."""
    docs = [(5, "ant bee"), (3, "ant bee"), (3, "ant bee"), (None, "ant cat"), (7, None), (8, ""), (9, "!? ..."), (4, "ant " * 5000), (4, "cat dog"), (-2, "dog")]
    items = [(1, "ant"), (1, "ant"), (1, "cat"), (2, None), (None, "ant"), (3, "..."), (4, "")]
    assert run(spark, docs, items) == brute(docs, items)


def test_more_ties_than_places(spark):
    docs = [(k, "ant bee") for k in range(500, 0, -1)] + [(1000 + k, "cat") for k in range(40)]
    got = run(spark, docs, [(1, "bee ant"), (2, "cat")], shard=64)
    assert [r[2] for r in got] == [*range(1, 11), *range(1000, 1010)]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "ant")]) == [] and run(spark, [(1, "ant")], []) == [] and run(spark, [(1, None)], [(1, "ant")]) == []


def test_extra_columns_of_clashing_names(spark):
    d = spark.createDataFrame([(1, "ant", 5, "x"), (2, "bee cow", 6, "y")], "doc_id long, text string, item long, `a.b` string")
    i = spark.createDataFrame([(9, "ant", 1.0)], "item_id long, text string, score double")
    assert [tuple(r) for r in search.rank(d, i, spark).collect()] == brute([(1, "ant"), (2, "bee cow")], [(9, "ant")])


def local_shard(docs):
    """A shard of [{term: tf}], ids from 0."""
    vocab = sorted({t for d in docs for t in d})
    rows = [(vocab.index(t), tf) for d in docs for t, tf in sorted(d.items())]
    row = {"ids": np.arange(len(docs)), "long": np.array([sum(d.values()) for d in docs]), "ends": np.cumsum([len(d) for d in docs]).astype(np.int32), "vocab": np.array(vocab, np.int64), "term": np.array([r[0] for r in rows], np.int32), "tf": np.array([r[1] for r in rows], np.int32)}
    n = sum(sum(d.values()) for d in docs)
    return search.Shard(row, len(docs), n, np.array(vocab, np.uint64)), n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 6), st.integers(1, 4), min_size=1), min_size=1, max_size=30), st.lists(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 9)), min_size=1, max_size=5, unique_by=lambda x: x[0]), min_size=1, max_size=4), st.integers(1, 4), st.integers(1, 4))
def test_threshold_search_of_one_shard(docs, items, top, depth):
    shard, n = local_shard(docs)
    items = [sorted(x) for x in items]
    first = np.cumsum([0, *map(len, items)])
    best = search.Best(len(items), top, np.ones(len(items), np.int64))
    search.threshold_search(shard, first, np.array([t for x in items for t, _ in x], np.uint64), np.array([w for x in items for _, w in x], np.int64), best, depth)
    for k, x in enumerate(items):
        want = []
        for d, have in enumerate(docs):
            m = 25 + 75 * sum(have.values()) * len(docs) // n
            s = sum(w * (10**9 * have[t] // (1000 * have[t] + 8 * m)) for t, w in x if t in have)
            if s > 0:
                want.append((-s, d))
        got = best.item == k
        assert list(zip((-best.score[got]).tolist(), best.doc[got].tolist())) == sorted(want)[:top]


def test_stops_before_the_end_of_the_lists():
    """One document stands out; of the others only those that the depth reached brings in are scored."""
    docs = [{0: 1, 1: 1, **{9: 1 + k % 50}} for k in range(4000)] + [{0: 40, 1: 40}]
    shard, _ = local_shard(docs)
    looked = []
    plain = shard.lookup
    shard.lookup = lambda doc, term: looked.append(len(doc)) or plain(doc, term)
    best = search.Best(1, 1, np.ones(1, np.int64))
    search.threshold_search(shard, np.array([0, 2]), np.array([0, 1], np.uint64), np.array([5, 5]), best)
    assert best.doc.tolist() == [4000] and sum(looked) < 100
