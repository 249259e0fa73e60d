import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from gaugeframe.llm import embedding_dedup, jaccard, line_dedup, suffix_dedup
from gaugeframe.llm.common import Scratch
from gaugeframe.llm.components import components, extended

DOCS = "doc_id long, text string"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# ---- 1 -------------------------------------------------------------------------------------------------------


def check_spans(spark, rows, schema=DOCS, length=suffix_dedup.LENGTH, block=suffix_dedup.BLOCK):
    got = suffix_dedup.digest(suffix_dedup.cut(spark.createDataFrame(rows, schema), spark, length, block)).collect()
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, spans in zip(rows, texts, suffix_dedup.brute_force(texts, length)):
        kept = b"".join(t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)]))
        want.append((r[0], len(t), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    symbols = [[w.lower() for w in brute.WORD.findall(t)] for t in texts]
    runs = suffix_dedup.brute_force([tuple(x) for x in symbols], suffix_dedup.WORDS.length)
    assert sorted(((r["doc_id"], r["n_passages"], r["n_passage_words"]) for r in got), key=repr) == sorted(((r[0], len(x), sum(b - a for a, b in x)) for r, x in zip(rows, runs)), key=repr)
    return want


def test_passages(spark):
    """Over 50 words that occur elsewhere, however they are spaced and capitalised, and whatever their length in bytes."""
    rng = random.Random(4)
    shared = words(rng, 60)
    own = lambda n: " ".join(f"o{rng.randrange(10**9)}" for _ in range(n))
    rows = [(1, f"{own(40)} {' '.join(shared)} {own(5)}"), (2, "\n".join(shared[3:]).upper()), (3, " ".join(shared[:50])), (4, own(200)), (5, None), (6, " ".join(shared[9:]) + own(3)), (None, f"{own(9)} {' '.join(shared)}")]
    check_spans(spark, rows)
    got = {r["doc_id"]: r["n_passage_words"] for r in suffix_dedup.digest(suffix_dedup.cut(spark.createDataFrame(rows, DOCS), spark)).collect()}
    assert got[1] == 60 and got[2] == 57 and got[3] == got[4] == 0


def test_suffix_dedup(spark):
    rng = random.Random(1)
    shared = " ".join(words(rng, 150))
    own = lambda n: " ".join(words(rng, n))
    near = shared.replace("w1", "x1", 1)
    rows = [
        (1, own(100) + " " + shared + " " + own(50)),
        (2, shared[7:] + own(80)),
        (3, own(30) + shared[100:560]),
        (4, shared[:399]),
        (5, shared[3:403]),
        (6, near),
        (7, near),
        (8, None),
        (9, ""),
        (10, "short"),
        (11, "a" * 900),
        (12, own(200)),
        (12, own(200)),
        (13, "ä€" * 300 + own(60)),
        (14, "b" + "ä€" * 300),
        (15, shared + shared),
        (None, shared[:450]),
    ]
    want = check_spans(spark, rows)
    assert sum(w[2] > 0 for w in want) >= 9


def test_suffix_dedup_of_equal_rows_and_empty_tables(spark):
    text = " ".join(words(random.Random(2), 120))
    check_spans(spark, [(1, text), (1, text), (2, text + "!")])
    check_spans(spark, [(1, None)])
    assert suffix_dedup.digest(suffix_dedup.cut(spark.createDataFrame([], DOCS), spark)).count() == 0
    extra = spark.createDataFrame([(1, text, "x", 5, 7)], DOCS + ", h string, lo int, bucket long")
    assert suffix_dedup.cut(extra, spark).count() == 1


def test_suffix_dedup_at_random(spark):
    rng = random.Random(3)
    pieces = ["".join(rng.choice("ab") for _ in range(rng.randrange(50, 700))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randrange(40) :] for _ in range(rng.randrange(1, 4)))) for i in range(40)]
    check_spans(spark, rows)
    check_spans(spark, [(i, t * 2) for i, t in rows[:12]], length=150, block=700)  # long texts go in blocks
    with pytest.raises(ValueError):
        suffix_dedup.Unit(60, 32, (48, 6, 1), 1).depth()


# ---- 7 -------------------------------------------------------------------------------------------------------


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 4))
def test_edit_within(a, b, tau):
    a, b = a.encode(), b.encode()
    want = brute.distance(a, b) <= tau
    assert line_dedup.edit_within(a, b, tau) == want and line_dedup.alike([a, b"", a], [b, b"", a], tau).tolist() == [want, True, True]


def test_long_lines_are_verified_at_once():
    x = np.random.default_rng(1).choice(np.frombuffer(b"abcdef ", np.uint8), 2_000_000).tobytes()
    assert line_dedup.edit_within(x, b"X" + x[1:-1] + b"Y", 2) and not line_dedup.edit_within(x, b"X" + x[1:-2] + b"YZ", 2)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 3), st.data())
def test_some_segment_is_found(tau, data):
    """Of two lines within tau, a segment of the shorter is in a window of the longer."""
    s = data.draw(st.text("ab", min_size=6, max_size=20))
    t = list(s)
    for _ in range(tau):
        i = data.draw(st.integers(0, len(t) - 1))
        kind = data.draw(st.sampled_from("ids"))
        if kind == "i":
            t.insert(i, "a")
        elif kind == "d" and len(t) > 1:
            del t[i]
        else:
            t[i] = "b"
    short, long = sorted(["".join(t), s], key=len)
    cut = line_dedup.segment_starts(np.array([len(short)]), tau)[0]
    hits = [
        short[cut[k] : cut[k + 1]] == long[cut[k] + x : cut[k + 1] + x]
        for k in range(tau + 1)
        for x in line_dedup.windows(k, len(long) - len(short), tau)
        if cut[k] + x >= 0 and cut[k + 1] + x <= len(long)
    ]
    assert any(hits)


def check_lines(spark, docs, least=24):
    out = line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), DOCS), spark, min_bytes=least)
    got = out.collect()
    assert {r["doc_id"]: (r["text"], list(r["removed"])) for r in got} == brute.line_dedup(docs, least=least)
    assert all(r["n_lines"] == (0 if docs[r["doc_id"]] is None else docs[r["doc_id"]].count("\n") + 1) for r in got)


def test_line_dedup(spark):
    rng = random.Random(4)
    base = " ".join(words(rng, 12))
    variants = []
    for _ in range(25):
        x = list(base)
        for _ in range(rng.randrange(1, 7)):
            i = rng.randrange(len(x))
            x[i : i + rng.randrange(2)] = rng.choice(["", "z", "é"])
        variants.append("".join(x))
    docs = {i: "\n".join(rng.choice([*variants, base, " ".join(words(rng, 9)), "short", ""]) for _ in range(4)) for i in range(30)}
    docs |= {100: None, 101: "", 102: "\n\n", 103: base, 104: base + "\n" + base, 105: "x" * 1500 + "\n" + "x" * 1501, 106: "y" * 23}
    check_lines(spark, docs)


def test_line_dedup_of_tiles(spark, monkeypatch):
    """Keys of more lines than a tile holds."""
    monkeypatch.setattr(line_dedup, "TILE", 8)
    rng = random.Random(5)
    head = "the same beginning of every line "
    docs = {i: head + "".join(rng.choice("ab") for _ in range(12)) for i in range(60)}
    check_lines(spark, docs)


def near_lines(rng, base, n):
    out = []
    for _ in range(n):
        x = list(base if rng.random() < 0.8 else base[: len(base) // 2] + "".join(rng.choice("abcd ") for _ in range(rng.randrange(4, 40))))
        for _ in range(rng.randrange(6)):
            i = rng.randrange(len(x))
            x[i : i + rng.randrange(2)] = rng.choice(["", "z", "yx"])
        out.append("".join(x))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_cuts_a_hot_key_again(spark, monkeypatch, seed):
    """Keys of more lines than a tile holds go by longer paths through the shuffle, then by segments within a task."""
    monkeypatch.setattr(line_dedup, "TILE", 20)
    rng = random.Random(seed)
    base = " ".join(words(rng, 20))
    check_lines(spark, {i: "\n".join(near_lines(rng, base, 4)) for i in range(60)})


def pairs_of(lines):
    one, n = np.ones(len(lines), bool), len(lines)
    c = {"ask": one, "answer": one, "own": one, "place": np.arange(n), "size": np.array([len(x) for x in lines]), "weigh": line_dedup.byte_counts(lines)[1]}
    for i, j in line_dedup.group_pairs(c, lines, np.zeros(n, int), 2, line_dedup.LEVELS):
        yield from zip(i.tolist(), j.tolist())


def test_all_alike_lines_of_a_group_are_proposed():
    rng = random.Random(6)
    for _ in range(6):
        lines = [x.encode() for x in dict.fromkeys(near_lines(rng, " ".join(words(rng, 14)), 90))]
        want = {(a, b) for a in range(len(lines)) for b in range(a) if brute.distance(lines[a], lines[b]) <= 2}
        assert {(a, b) for a, b in pairs_of(lines) if brute.distance(lines[a], lines[b]) <= 2} == want


def test_lines_with_one_beginning_are_not_paired():
    """A group of lines that share a long beginning only costs next to no pair."""
    rng = random.Random(7)
    for n in (500, 4000):
        lines = [b"the same beginning of every line, forty-eight bytes" + bytes(rng.choice(b"abcdefgh ") for _ in range(60)) for _ in range(n)]
        assert sum(1 for _ in pairs_of(lines)) < n


def test_line_dedup_of_every_line(spark):
    """With a least length of 0, lines of any length count."""
    rng = random.Random(10)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(30)] + ["", "-", "=======", "========="]
    check_lines(spark, {i: "\n".join(rng.choice(texts) for _ in range(3)) for i in range(25)}, least=0)


def test_line_dedup_of_odd_rows(spark):
    text = "a line that is long enough to count"
    df = spark.createDataFrame([(None, text, "p"), (2, text, None), (1, text + "!", "q"), (3, None, "r")], "doc_id long, text string, _removed string")
    out = {r["_removed"]: r["text"] for r in line_dedup.dedup_lines(df, spark).collect()}
    assert out == {"p": text, None: "", "q": text + "!", "r": None}


def check_parts(spark, *parts):
    """check_lines of documents that lie in one partition for each part, so that each has chunks of its own."""
    df = spark.createDataFrame(spark.sparkContext.parallelize([list(p.items()) for p in parts], len(parts)).flatMap(lambda x: x), DOCS)
    want = brute.line_dedup({k: v for p in parts for k, v in p.items()})
    assert {r["doc_id"]: (r["text"], list(r["removed"])) for r in line_dedup.dedup_lines(df, spark).collect()} == want
    return want


def test_line_dedup_meets_the_first_line_in_every_chunk(spark):
    """The third is alike to the first only, and its chunk has another leader of the segment they share."""
    want = check_parts(spark, {1: "abcdefghij" + "klmnopqrst" + "uvwxyzabcd"}, {2: "0123456789" + "9876543210" + "uvwxyzabcd", 3: "abcdeXghij" + "klmnoXqrst" + "uvwxyzabcd"})
    assert want[3] == ("", [0])


def test_line_dedup_of_many_chunks(spark):
    rng = random.Random(9)
    segments = [["".join(rng.choice("abcdefgh") for _ in range(10)) for _ in range(4)] for _ in range(3)]

    def line():
        x = list("".join(rng.choice(s) for s in segments))
        for _ in range(rng.randrange(3)):
            x[rng.randrange(30)] = rng.choice("xyz")
        return "".join(x)

    docs = [{p * 10 + i: "\n".join(line() for _ in range(2)) for i in range(6)} for p in range(4)]
    want = check_parts(spark, *docs)
    assert 0 < sum(len(x[1]) for x in want.values()) < 48


def test_line_dedup_of_dot_leaders_in_chunks(spark):
    """A run of one byte has the same segment at every shift: the line's index row stands for its key, not a probe."""
    lines = {i: f"{i} Intro {'.' * 24} 1{i + 1}" for i in (1, 2, 3)}
    want = check_parts(spark, *({i: x} for i, x in lines.items()))
    assert want[2] == want[3] == ("", [0])
    check_parts(spark, {1: "-" * 40, 2: "ab" + "-" * 50}, {3: "-" * 41 + "+", 4: "cd" + "-" * 49}, {5: "+" + "-" * 40 + "+"})


def test_line_dedup_keeps_columns(spark):
    df = spark.createDataFrame([(1, "t", 5, "k")], DOCS + ", removed int, key string")
    out = line_dedup.dedup_lines(df, spark)
    assert out.columns == ["doc_id", "text", "removed", "key", "_removed", "n_lines"] and tuple(out.first()) == (1, "t", 5, "k", [], 1)
    assert line_dedup.dedup_lines(df.limit(0), spark).count() == 0


# ---- 8 -------------------------------------------------------------------------------------------------------


def check_vectors(spark, rows, cosine=0.93):
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), spark, cosine).collect()}
    good = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (label, np.array(v, np.float32).astype(float))
    cos = lambda a, b: a @ b / np.sqrt((a @ a) * (b @ b))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and cos(good[a][1], good[b][1]) >= cosine]
    c = brute.components([r[0] for r in rows], links)
    want = {r[0]: (sum(r[0] in x for x in links), c[r[0]], c[r[0]] == r[0]) for r in rows}
    assert got == want
    return links


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(220):
        if i % 3 and rows:
            j = rng.integers(len(rows))
            v = np.array(rows[j][1]) + rng.normal(0, 0.22, 6)
        else:
            v = rng.normal(size=6)
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 2)))
    same = [1.0, 2.0, 3.0, 0.0, 0.0, 0.0]
    rows += [(1000 + i, same, 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, [float("nan")] * 6, 1), (2003, [float("inf"), 1.0], 1), (2004, [None, 1.0], 1), (2005, same, None), (2006, [], 1), (2007, [1.0, 2.0], 1), (2008, [1.0, 2.0], 1)]
    assert len(check_vectors(spark, rows)) > 800


def test_embeddings_of_many_lengths_and_clashing_columns(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i // 2)] if i % 2 == 0 else None, 1) for i in range(240)]
    rows = [(i, v if v is not None else rows[i - 1][1], label) for i, v, label in rows]
    assert len(check_vectors(spark, rows)) >= 120
    df = spark.createDataFrame([(*r, 5, "x", 1, 2.0) for r in rows[:6]] + [(None, [1.0], 1, 5, "x", 1, 2.0)], "vec_id long, embedding array<float>, label int, id int, v string, dim int, Copies double")
    assert sorted(((r["vec_id"], r["n_links"]) for r in embedding_dedup.near_duplicates(df, spark).collect()), key=repr) == sorted([*((i, 1) for i in range(6)), (None, 0)], key=repr)


def test_a_dense_group_of_vectors(spark):
    """A group in which all are linked costs a link for each vector."""
    hit = np.ones((3000, 3000), bool)
    i, j = embedding_dedup.spanning(hit, np.arange(3000))
    assert len(i) < 6001
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    check = [(i, [float(x) for x in np.float32(base + rng.normal(0, 0.01, 16))], 0) for i in range(150)]
    assert len(check_vectors(spark, check)) == 150 * 149 // 2


def test_copies_of_points_come_in_bounded_batches():
    """Vectors that go to every one of 256 cells are handed on a bounded number at a time."""
    rows = 1000
    v = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * 64), pa.array(np.ones(rows * 64, np.float32)))
    one = pa.array(np.arange(rows))
    b = pa.RecordBatch.from_arrays([one, one, one, one, v], ["label", "dim", "id", "copies", "v"])
    at, cell = np.nonzero(np.ones((rows, 256), bool))
    sizes = [(len(x), x.nbytes) for x in embedding_dedup.handed_on(b, at, cell, cell == 0)]
    assert sum(n for n, _ in sizes) == rows * 256
    assert max(n for n, _ in sizes) <= embedding_dedup.BATCH and max(m for _, m in sizes) < 4 << 20


def test_pairs_at_the_threshold_are_decided_in_double(spark):
    """Cosines that differ from the threshold by less than single precision tells."""
    angle = np.arccos(0.93)
    rows = []
    for i, off in enumerate((-3e-7, -3e-6, -1e-5, 3e-7, 3e-6, 1e-5)):
        rows += [(10 * i, [1.0, 0.0], i), (10 * i + 1, [float(np.cos(angle + off)), float(np.sin(angle + off))], i)]
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), spark).collect()}
    assert [got[10 * i] for i in range(6)] == [1, 1, 1, 0, 0, 0]


def test_embedding_dedup_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), spark).count() == 0
    check_vectors(spark, [(1, None, 1)])


# ---- 9 -------------------------------------------------------------------------------------------------------


def check_jaccard(spark, docs):
    rows = list(docs.items())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, DOCS), spark).collect()}
    want = brute.jaccard(docs)
    assert got == want
    return want


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randrange(most)):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


def test_jaccard(spark):
    rng = random.Random(7)
    base, other, long = words(rng, 120), words(rng, 40), words(rng, 1500)
    texts = near_copies(rng, base, 40, 12) + near_copies(rng, other, 20, 4) + near_copies(rng, long, 6, 60)
    texts += [" ".join(words(rng, 60)) for _ in range(20)] + [" ".join(base[:60] + words(rng, 60)) for _ in range(10)]
    texts += [" ".join(base)] * 5 + [None, "", " \t\n", "a b", "A  b", "a b c d e", "one", "a\xa0b c", "É x", "é x"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    want = check_jaccard(spark, {i: texts[j] for i, j in enumerate(order)})
    assert len({c for _, c in want.values()}) < len(want) - 30


def test_jaccard_with_salts_and_tiles(spark, monkeypatch):
    """Every shingle counts as frequent, and runs are longer than a tile."""
    monkeypatch.setattr(jaccard, "SALT_ROWS", 4)
    monkeypatch.setattr(jaccard, "TILE", 4)
    rng = random.Random(8)
    base = words(rng, 80)
    check_jaccard(spark, dict(enumerate(near_copies(rng, base, 60, 10))))


def test_jaccard_threshold_is_inclusive(spark):
    """7 shingles against 9 with 7 shared fall short of, 6 of 8 meet, three quarters."""
    w = [f"w{i}" for i in range(40)]
    assert check_jaccard(spark, {1: " ".join(w[:10]), 2: " ".join(w[:12])})[2] == (8, 1)
    assert check_jaccard(spark, {1: " ".join(w[:10]), 2: " ".join(w[:13])})[2] == (9, 2)


def test_jaccard_of_repeated_rows_and_nothing(spark):
    assert jaccard.classes(spark.createDataFrame([], DOCS), spark).count() == 0
    t = " ".join(words(random.Random(9), 30))
    rows = [(1, t), (1, t), (2, t), (3, None)]
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows, DOCS), spark).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]
    rows += [(None, t), (None, "a b"), (None, None)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(spark.createDataFrame(rows[::-1], DOCS), spark).collect()]
    assert sorted(got, key=repr) == sorted([(1, 26, 1), (1, 26, 1), (2, 26, 1), (3, 0, 3), (None, 26, None), (None, 1, None), (None, 0, None)], key=repr)
    one = jaccard.one_of_each(spark.createDataFrame([(*r, 0, "t") for r in [*rows[:4], (None, "x")]], DOCS + ", n int, token string"), spark)
    assert sorted(r["doc_id"] or 0 for r in one.collect()) == [0, 1, 3] and one.columns == ["doc_id", "text", "n", "token"]


def test_short_lines_repeat_exactly_or_stay(spark):
    """Under the least length only exact repeats go, in the order of documents and lines; empty lines stay."""
    docs = {1: "}\n\nend\n}", 2: "}\nEnd\n\nend", 3: "}" * 24 + "\n" + "}" * 23, 4: "}" * 23 + "\n" + "}" * 25, 5: "é\né", 6: "\n\n"}
    check_lines(spark, docs)
    assert brute.line_dedup(docs)[2] == ("End\n", [0, 3])


LINKS = {
    "path": [(i, i + 1) for i in range(10_000)],
    "star": [(5000, i) for i in range(5000)] + [(5000, i) for i in range(5001, 9000)],
    "ladder": [e for i in range(2000) for e in ((2 * i, 2 * i + 1), (2 * i, 2 * i + 2), (2 * i + 1, 2 * i + 3))],
    "pairs": [(2 * i, 2 * i + 1) for i in range(3000)],
}


@pytest.mark.parametrize("kind, most", [("path", 20), ("star", 20), ("ladder", 20), ("pairs", 2)])
def test_rounds_of_components(spark, kind, most):
    """The rounds grow with the logarithm of the nodes, whatever the order of their ids."""
    scratch = Scratch(spark, "t")
    kept = []
    plain = scratch.keep
    scratch.keep = lambda df: kept.append(df) or plain(df)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(LINKS[kind], "a long, b long"), scratch).collect()}
    assert (len(kept) - 3) / 2 <= most  # two tables a round, the links before and the names after
    nodes = {x for e in LINKS[kind] for x in e}
    assert got == ({n: n // 2 * 2 for n in nodes} if kind == "pairs" else dict.fromkeys(nodes, 0))


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    ids = list(range(200))
    links = [(rng.choice(ids), rng.choice(ids)) for _ in range(130)] + [(i, i + 1) for i in range(0, 40)] + [(7, x) for x in range(100, 130)]
    scratch, df = Scratch(spark, "t"), lambda x: spark.createDataFrame(x, "a long, b long")
    named = components(df(links), scratch)
    check = lambda got, links: {r["node"]: r["component"] for r in got.collect()} == {i: c for i, c in brute.components(ids, links).items() if any(a != b and i in (a, b) for a, b in links)}
    assert check(named, links)
    more = [(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(40)) if a != b]
    assert check(extended(named, df(more), scratch), links + more)
    assert check(extended(components(df([]), scratch), df(more), scratch), more)
