import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from gaugeframe.llm import debruijn

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(docs, window=35):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text), by counting every window."""
    texts = [WORD.findall((t or "").encode()) for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(docs, texts):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, window=35, k=12):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = debruijn.digest(debruijn.cut(d, spark, window, k)).collect()
    assert all((r["n_spans"] > 0) == (r["n_removed"] > 0) for r in rows)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=repr)


def edited(seed, n=60, kinds=400):
    """Texts that share passages, with edits, insertions and repeats within a text; few kinds of words make k-mers branch."""
    rng = np.random.default_rng(seed)
    word = lambda m: [f"w{x}" for x in rng.integers(0, kinds, m)]
    shared = [word(int(m)) for m in rng.integers(20, 120, 8)]
    out = []
    for d in range(n):
        parts = []
        for _ in range(rng.integers(1, 5)):
            p = list(shared[rng.integers(0, len(shared))]) if rng.random() < 0.7 else word(int(rng.integers(1, 60)))
            if rng.random() < 0.5:
                p[rng.integers(0, len(p))] = "edit"
            lo = rng.integers(0, len(p))
            parts += p[lo:] if rng.random() < 0.3 else p
        out.append((d, " ".join(parts)))
    return out


@pytest.mark.parametrize("seed, window, k, kinds", [(1, 35, 12, 400), (2, 35, 12, 3), (3, 9, 3, 4), (4, 6, 5, 2), (5, 4, 1, 2), (6, 35, 34, 30)])
def test_equal_to_counting_every_window(spark, seed, window, k, kinds):
    docs = edited(seed, kinds=kinds)
    assert run(spark, docs, window, k) == brute(docs, window)


def test_odd_rows(spark):
    """Nulls, empty texts, exact repeats of a row, shared ids, runs of one word, texts of one word less than a window, long texts."""
    run_of = " ".join(["x"] * 90)
    a = " ".join(f"a{i}" for i in range(50))
    just, less = (" ".join(f"b{i}" for i in range(n)) for n in (35, 34))
    long = " ".join(f"l{i}" for i in range(40_000))
    docs = [(1, None), (2, ""), (3, " \t\n "), (4, run_of), (5, a), (5, a), (None, just), (None, "y " + just.replace(" ", "\n")), (6, less), (7, less), (8, a.upper()), (9, long), (10, "z " + long), (10, a.replace("a49", "é"))]
    assert run(spark, docs) == brute(docs)


def test_periodic_text_of_one_document(spark):
    docs = [(1, " ".join(f"p{i % 7}" for i in range(200))), (2, " ".join(f"q{i}" for i in range(80)))]
    assert run(spark, docs) == brute(docs)


def test_many_copies_of_one_passage(spark):
    """A group of copies shares a passage whose ends differ in every text."""
    passage = " ".join(f"s{i}" for i in range(60))
    docs = [(i, f"u{i} v{i} {passage} e{i % 5} f{i}") for i in range(300)]
    assert run(spark, docs) == brute(docs)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    a = " ".join(f"a{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a, 3, "x"), (2, a, 4, "y")], "doc_id long, text string, kmer int, `Edges.x` string")
    assert [r["n_removed"] for r in debruijn.digest(debruijn.cut(docs, spark)).collect()] == [50, 50]
    with pytest.raises(ValueError):
        debruijn.cut(docs, spark, 5, 5)


def test_windows_of_long_paths_are_not_named(spark):
    """Of two texts with one long copy, only the windows that leave the copy are named."""
    long = " ".join(f"l{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, "a " + long + " b"), (2, "c d " + long)], "doc_id long, text string")
    from pyspark.sql import functions as F

    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("h"), F.encode("text", "UTF-8").alias("text"))
    found = debruijn.edges(keyed, 35, 12)
    lists = found.join(debruijn.repeated(found), "kmer").groupBy("doc", "h").agg(F.collect_list(F.struct("at", "lo", "hi", "one_in", "one_out")).alias("edges"))
    assert debruijn.leaving(keyed.join(lists, ["doc", "h"]), 35, 12).count() < 150


def test_names_of_spans():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 600_000).astype(np.uint64)
    h[300_000:300_100] = h[:100]
    lo = np.array([0, 10, 262_100, 300_000, 300_010])
    a, b = (debruijn.span_names(h, lo, lo + n, debruijn.BASES[0]) for n in (50, 51))
    assert a[0] == a[3] and a[1] == a[4] and len(set(a.tolist())) == 3 and not set(a.tolist()) & set(b.tolist())
