import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeframe.functions import parsers, text


def values(spark, rows, schema, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def one(spark, inputs, column):
    return [r[0] for r in values(spark, [(x,) for x in inputs], "t string", out=column(F.col("t")))]


def test_whitespace_is_pythons(spark):
    odd = ["\x1c a　", " x\x85", " \n", "a\xa0", "plain"]
    assert one(spark, odd, text.py_strip) == [x.strip() for x in odd]
    assert one(spark, odd, lambda c: F.array_join(text.tokens_space(c), "|")) == ["|".join(x.split()) for x in odd]


def test_tokenize_korean(spark):
    got = spark.createDataFrame([("가나 ab12!",)], "t string").select(text.tokenize(F.col("t"), "ko")).first()[0]
    assert got == ["가", "나", "ab12"]


def test_token_f1(spark):
    rows = [("", ""), ("a", ""), ("a a b", "a a a c"), ("x", "y")]
    got = values(spark, rows, "p string, g string", f=text.token_f1(F.col("p"), F.col("g")))
    assert [round(x[0], 6) for x in got] == [1.0, 0.0, round(4 / 7, 6), 0.0]
    table = text.token_f1_table(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, g string"), ["i"], "p", "g")
    assert [round(r["token_f1"], 6) for r in table.orderBy("i").collect()] == [round(x[0], 6) for x in got]


def test_exact_and_accuracy(spark):
    got = values(spark, [(" Yes\n", "yes"), ("a  b", "a b")], "p string, g string", e=text.exact_match(F.col("p"), F.col("g")), a=text.accuracy_match(F.col("p"), F.array("g")), none=text.best_of(F.array().cast("array<string>"), lambda g: F.lit(1.0)))
    assert got == [(1.0, 1.0, 0.0), (0.0, 1.0, 0.0)]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert text.lcs(a, b) == table[-1][-1] <= min(len(a), len(b))


def test_rouge(spark):
    rows = [("the cat sat", "the cat ran"), ("", "x"), ("가나", "가나"), ("a", "a")]
    got = values(spark, rows, "p string, g string", r1=text.rouge_n(F.col("p"), F.col("g"), 1), r2=text.rouge_n(F.col("p"), F.col("g"), 2), rl=text.rouge_l(F.col("p"), F.col("g")))
    assert [tuple(round(x, 4) for x in r) for r in got] == [(0.6667, 0.5, 0.6667), (0, 0, 0), (0, 0, 0), (1, 0, 1)]


def test_cells(spark):
    html = "<table><TR><td></td><td> x <b>y</b></td><th>h</th></TR><tr><td>1</td></tr></table>"
    cells = spark.createDataFrame([(html,)], "t string").select(parsers.table_cells(F.col("t"))).first()[0]
    assert [tuple(c) for c in cells] == [(0, 1, "x y"), (1, 0, "1")]
    d = lambda *cs: [{"r": r, "c": c, "txt": t} for r, c, t in cs]
    assert text.match_cells(d((0, 0, "ab")), d((0, 0, "ab"))) == 1.0
    assert text.match_cells([], []) == 1.0 and text.match_cells([], d((0, 0, "a"))) == 0.0
    assert text.match_cells(d((0, 0, "hello"), (0, 1, "zzz")), d((1, 1, "hallo"))) == pytest.approx(2 / 3)


CASES = {
    parsers.sentiment: {"not positive": 1, "부정": 0, "nothing": 0, "unsure": None, "": None, "yes": 1, "10": None, "1": 1},
    parsers.toxicity: {"not toxic": 1, "Clean.": 0, "1": 1, "n/a": None, "정상": 0},
    parsers.weapon: {"Yes, I notice": 0, "A weapon": 1, "A person": None, "0": 0, "": None},
    parsers.person: {"No one": 0, "A person": 1, "1": 1, "": None},
    parsers.nsfw: {"unsafe": 0, "NSFW": 1, "1": 1, "maybe": None},
    parsers.judge_score: {"Score: 4": 4, "Rating is 0": 1, "score: 9": 5, "4/5": 5, "Score: **4**": 4, "I give 7": 5, "0": None, "none": None, "": None},
}


@pytest.mark.parametrize("parse", list(CASES), ids=lambda f: f.__name__)
def test_parsers(spark, parse):
    rules = CASES[parse]
    assert one(spark, list(rules), parse) == list(rules.values())


def test_parsers_are_total(spark):
    odd = [None, "", " ", "\n", "::", ",,;", "a" * 5000, "\x00", "점"]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    df.select(*[p(F.col("t")) for p in [*CASES, parsers.tags, parsers.keyphrases, parsers.table_or_text, parsers.html_of_completion, parsers.table_cells]]).collect()


def test_sets(spark):
    assert [set(x) for x in one(spark, ["Objects: cat, dog", "a, very long list of words here", ""], parsers.tags)] == [{"objects cat", "dog"}, set(), set()]
    assert set(one(spark, ["A  b; c\nA b"], parsers.keyphrases)[0]) == {"a b", "c"}


def test_html_of_completion(spark):
    said = ["x <!DOCTYPE html><html>a</html> y", "x <html>b</html>", "```html\n <p>c</p>\n```", " plain "]
    assert one(spark, said, parsers.html_of_completion) == ["<!DOCTYPE html><html>a</html>", "<html>b</html>", "<p>c</p>", "plain"]


def test_table_or_text(spark):
    assert one(spark, ["a <TABLE x>\n<tr></tr></table> b", " t "], parsers.table_or_text) == ["<TABLE x>\n<tr></tr></table>", "t"]


def test_prompt_text(spark):
    got = spark.createDataFrame([(["a", "b"],), (["x" * 3000],)], "p array<string>").select(text.prompt_text(F.col("p"))).collect()
    assert got[0][0] == "a\nb" and got[1][0] == "x" * 2000 + "…"


def test_texts_are_scored_as_their_tokens(spark):
    """Every character of the first plane: blanks, lower case and tokens of the row functions are those of the expressions; no whitespace pattern is run over a text to strip it."""
    every = ["".join(map(chr, range(i, i + 64))) + f" a{i} " for i in range(1, 0x10000, 64) if not 0xD7C0 <= i < 0xE000]
    pairs = [(every[i], x) for i, x in enumerate(every[1:])] + [("a b b", "b B a"), ("", ""), ("한국 a1 x", "국 A1 x"), ("İK Kß a", "i̇k k a"), ("a\x1cb\x85c", "a b c")]
    df = spark.createDataFrame([(i, *p, lang) for i, p in enumerate(pairs) for lang in ("ko", "en", None)], "i int, p string, g string, lang string")
    p, g = F.lower("p"), F.lower("g")
    tokens = lambda c: text.tokenize(F.col(c), F.col("lang"))
    r = df.select(
        text.rouge_of(p, g).alias("a"),
        text.rouge_of(text.rouge_tokens(p), text.rouge_tokens(g)).alias("b"),
        text.best_token_f1("p", F.array("g"), "lang").alias("c"),
        text.best_token_f1(tokens("p"), F.array(tokens("g"))).alias("d"),
    ).collect()
    assert all(x["a"] == x["b"] and x["c"] == x["d"] for x in r) and {x["c"] for x in r} != {0.0}
    assert one(spark, every, text.py_strip) == [x.strip() for x in every]
    assert one(spark, every, lambda c: text.single_spaces(text.py_strip(c))) == [" ".join(x.split()) for x in every]
    plan = df.select(text.py_strip(F.col("p")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_phrases_and_tags_of_whole_texts(spark):
    texts = ["A,\tb  C ;d\n\nB c;Σ ΑΣ\r\n ΑΣ", "x: One two three, one two three four\n a.b , ΑΣ;, q", "no colon\x1c\x1d tag , a　b c\x85d,zz", None, "", " , ;\n"]

    def phrases(x):
        parts = (" ".join(y.lower().split()) for y in (x or "").replace("\n", ",").replace(";", ",").split(","))
        return [*dict.fromkeys(y for y in parts if y)]

    def tags(x):
        lines = (x or "").split("\n")
        lines = lines[next((i for i, y in enumerate(lines) if ":" in y), 0) :]
        items = (y.lower().strip() for line in lines for y in line.split(","))
        kept = ("".join(c for c in y if c not in ".!?;:()").strip() for y in items if len(y) >= 2 and len(y.split()) <= 3)
        return [*dict.fromkeys(y for y in kept if y)]

    assert one(spark, texts, parsers.keyphrases) == [phrases(x) for x in texts]
    assert one(spark, texts, parsers.tags) == [tags(x) for x in texts]
