import html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from compare import SF
from gaugeframe.functions import markup
from gaugeframe.operators import artifacts


class Plain(HTMLParser):
    """Start tags with first attributes, and text between tags."""

    def __init__(self):
        super().__init__()
        self.tags, self.nodes, self.open, self.raw = [], [], False, None

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.tags.append((tag, first))
        self.open, self.raw = False, tag if tag in ("script", "style") else None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.raw = None

    def handle_data(self, data):
        if self.open:
            self.nodes[-1] = (self.nodes[-1][0] + data, self.nodes[-1][1])
        else:
            self.nodes.append((data, self.raw))
        self.open = True

    def _cut(self, *_):
        self.open = False

    handle_comment = handle_decl = handle_pi = unknown_decl = _cut

    def handle_endtag(self, tag):
        self.open, self.raw = False, None


def parsed(page):
    p = Plain()
    p.feed(page)
    p.close()
    return p


PAGES = [
    "<!DOCTYPE html><section class='slide'>a<b>c</b></section>",
    "<!-- <section class=slide> --><section>x</section><!-- y -- >z",
    "<script>var a = '<section>'; // </p></script><section data-x=\"a>b <section>\" class=\"other slide\">t</section>",
    "<style>p > .slide{}</style><STYLE type=x>&amp;</STYLE >after",
    "a < b && c <3 d <> e",
    "&lt;section&gt; &amp;amp; &#65;&#x42; &#x1F600; &#128; &#0; &#55296; &#99999999; &notit; &copy &nosuch; &AMP &#; &#x; & &;",
    "<p title=\"class='slide'\" id=x>1</p><p class = slide>2</p><p class=slide class=no>3</p><p CLASS='a&#32;slide'>4</p><p class>5</p><p data-class=slide>6</p><p class='slides'>7</p>",
    "<br/><img src=a.png/><input disabled value=x/><hr class=slide />",
    "</section junk><//x></ y>text<?php echo '<b>' ?>more<![CDATA[x]]>end",
    "<link rel=stylesheet href='https://x/y'><link rel='stylesheet alternate' href=http://z><script src=\"http://s\"></script><script async src=//t></script><LINK REL=stylesheet HREF=HTTP://U>",
    "<a\nhref = '1'\tclass\n=\n\"slide\nx\">n</a>",
    "plain text only",
    "<section>é &eacute;&Eacute; 가</section>",
    "x<scripty>a</scripty><styled class=slide>b</styled>",
    "<script/>self <b>closed</b>",
]


def tokens_of(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i long, page string")
    t = F.col("t")
    df = df.withColumn("t", markup.tokens(F.col("page"))).withColumn("tags", markup.start_tags(t))
    named = F.transform("tags", lambda x: F.struct(markup.tag_name(x).alias("name"), *[markup.attribute(x, a).alias(a) for a in ("class", "rel", "href", "src")]))
    return {r["i"]: r for r in df.select("i", "page", "t", named.alias("tags"), markup.texts(t).alias("texts"), markup.texts(t, raw=False).alias("strict")).collect()}


def check(r):
    want = parsed(r["page"])
    assert "".join(r["t"]) == r["page"]
    assert [x["name"] for x in r["tags"]] == [t for t, _ in want.tags], r["page"]
    for x, (_, attrs) in zip(r["tags"], want.tags):
        assert {a: x[a] for a in ("class", "rel", "href", "src")} == {a: attrs.get(a) for a in ("class", "rel", "href", "src")}, r["page"]
    assert list(r["texts"]) == [t for t, _ in want.nodes], r["page"]
    assert list(r["strict"]) == [t for t, raw in want.nodes if raw is None], r["page"]


def test_fixtures_as_the_standard_parser_has_them(spark):
    for r in tokens_of(spark, PAGES).values():
        check(r)


def test_pages_as_the_standard_parser_has_them(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()]
    for r in tokens_of(spark, pages).values():
        check(r)


def test_random_pages_of_whole_tags(spark):
    rng = random.Random(4)
    bits = ["<section class='slide'>", "<p class=\"a slide\" id=1>", "</p>", "text ", "&amp;", "&#39;x", "<!-- <p> -->", "<script>if (a<b) '</p>'</script>", "<style>.a>b{}</style>", "<br/>", "< ", "é", "<a href='x>y'>", "\n", "<P CLASS=slide>", "<!doctype html>", "&nbsp;", "a&b;c"]
    for r in tokens_of(spark, ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(150)]).values():
        check(r)


def test_unescape_as_the_standard_library(spark):
    names = [f"&{n}" for n in html.entities.html5] + [f"&{n}x" for n in markup._LOOSE] + [f"&#{i};" for i in (*range(300), 0xFFFE, 0xFDD0, 0x10FFFF, 0x110000)] + [f"&#x{i:X}" for i in range(120, 180)]
    text = [" ".join(names[i : i + 40]) for i in range(0, len(names), 40)]
    df = spark.createDataFrame([(x,) for x in text], "x string").select("x", markup.unescape(F.col("x")).alias("y"))
    for r in df.collect():
        assert r["y"] == html.unescape(r["x"])


def test_what_never_ends_holds_no_elements(spark):
    pages = ["a<!-- b <section> c", "<section>x</section><p class='slide", "<script>var x = '<section>'", "<section"]
    got = tokens_of(spark, pages)
    assert [[x["name"] for x in r["tags"]] for r in got.values()] == [[], ["section"], ["script"], []]


@pytest.mark.parametrize("strict, found", [(False, 1), (True, 0)])
def test_scripts_and_styles_count_as_text_unless_strict(spark, strict, found):
    df = spark.createDataFrame([("<script>lake</script><section>R&amp;D</section><!-- <section> -->",)], "html string")
    r = artifacts.validate(df, {"lake": ["lake"], "rd": ["r&d"]}, 1, 2, strict=strict).first()
    assert (r["slide_count"], r["keywords_found"], r["external_refs"]) == (1, found + 1, 0)
