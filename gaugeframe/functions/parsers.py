"""Parsers of free text answers: ordered substring rules as Column expressions, total on any string.

The patterns of tables, rows, cells, fences, documents and scores are fixed values, as results depend on them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank, normalize, py_strip, single_spaces


def stripped(c: Column) -> Column:
    return py_strip(c)


def table_or_text(c: Column) -> Column:
    """The first table element, else the stripped text."""
    found = F.regexp_extract_all(c, F.lit(r"(?is)<table[^>]*>.*?</table>"), 0)
    return F.coalesce(F.get(found, F.lit(0)), py_strip(c))


def _has(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def _digit(c: Column, d: int) -> Column:
    return c.rlike(rf"(?U)\b{d}\b")


def _rules(c: Column, rules: list[tuple[Column, int]]) -> Column:
    out = F.when(is_blank(c), F.lit(None).cast("int"))
    for hit, value in rules:
        out = out.when(hit, value)
    return out


# The words of the answer rules, in the order in which they apply.
def sentiment(c: Column) -> Column:
    t = py_strip(F.lower(c))
    return _rules(c, [(_has(t, "positive"), 1), (_has(t, "negative"), 0), (_has(c, "긍정"), 1), (_has(c, "부정"), 0), (_digit(t, 1) | _has(t, "yes", "true"), 1), (_digit(t, 0) | _has(t, "no", "false"), 0)])


def toxicity(c: Column) -> Column:
    t = py_strip(F.lower(c))
    return _rules(c, [(_has(t, "toxic"), 1), (_has(t, "clean"), 0), (_has(c, "유해"), 1), (_has(c, "정상"), 0), (_digit(t, 1), 1), (_digit(t, 0), 0)])


def weapon(c: Column) -> Column:
    t = py_strip(F.lower(c))
    return _rules(c, [(_has(t, "no"), 0), (_has(t, "yes", "threat", "weapon"), 1), (_digit(t, 1), 1), (_digit(t, 0), 0)])


def nsfw(c: Column) -> Column:
    t = py_strip(F.lower(c))
    return _rules(c, [(_has(t, "nsfw"), 1), (_has(t, "safe"), 0), (_digit(t, 1), 1), (_digit(t, 0), 0)])


def person(c: Column) -> Column:
    t = py_strip(F.lower(c))
    return _rules(c, [(_has(t, "no"), 0), (_has(t, "yes", "person", "people"), 1), (_digit(t, 1), 1), (_digit(t, 0), 0)])


def keyphrases(c: Column) -> Column:
    """Distinct normalised phrases between commas, semicolons and newlines."""
    # the whole text is normalised before it is cut
    parts = F.split(single_spaces(F.lower(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(",")))), "[;,]")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def keyphrase_list(c: Column) -> Column:
    """Gold phrases of a semicolon-separated text."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), normalize), lambda x: x != ""))


def tags(c: Column) -> Column:
    """Distinct short tags from the first line that holds a colon on, that line included."""
    lines = F.split(F.lower(F.coalesce(c, F.lit(""))), "\n")
    at = F.try_element_at(F.filter(F.transform(lines, lambda x, i: F.when(x.contains(":"), i + 1)), lambda x: x.isNotNull()), F.lit(1))
    lines = F.slice(lines, F.coalesce(at, F.lit(1)), F.size(lines))
    items = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda y: py_strip(y))))
    many = r"(?U)^(?:[^\s\x1c-\x1f]++[\s\x1c-\x1f]++){3}"  # a stripped text of four words or more
    items = F.filter(items, lambda x: (F.char_length(x) >= 2) & ~x.rlike(many))
    items = F.transform(items, lambda x: py_strip(F.regexp_replace(x, r"[.!?;:()]", "")))
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def judge_score(c: Column) -> Column:
    """1 to 5 or null: a named score, else the last lone digit 1-5, else the last number that isn't 0, clamped."""
    t = py_strip(c)
    clamp = lambda x: F.when(x.isNotNull(), F.least(F.lit(5), F.greatest(F.lit(1), x))).cast("int")
    named = F.nullif(F.regexp_extract(t, r"(?iU)(?:score|rating)(?:\s+is)?[\s:]+(\d+(?:\.\d+)?)", 1), F.lit(""))
    named = clamp(F.floor(named.try_cast("double")))
    lone = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?U)\b([1-5])\b"), 1), F.lit(-1)).try_cast("int")
    number = F.try_element_at(F.regexp_extract_all(t, F.lit(r"(?U)\d+"), 0), F.lit(-1)).try_cast("decimal(38,0)")
    last = F.when(number != 0, clamp(number))
    return F.coalesce(named, lone, last)


def html_of_completion(c: Column) -> Column:
    """The document from its doctype (else <html) to the last </html>; else the first fenced block; else the stripped text."""
    whole = F.regexp_extract(c, r"(?is)<!doctype.*</html>", 0)
    html = F.regexp_extract(c, r"(?is)<html.*</html>", 0)
    block = r"(?is)```(?:html)?\s*(.*?)```"
    fence = F.when(c.rlike(block), py_strip(F.regexp_extract(c, block, 1)))
    has_doctype = F.lower(c).contains("<!doctype")
    return F.coalesce(F.when(has_doctype, F.nullif(whole, F.lit(""))).otherwise(F.nullif(html, F.lit(""))), fence, py_strip(c))


def table_cells(html: Column) -> Column:
    """array<struct<r, c, txt>> of the non-empty td cells; th cells don't count, empty ones still take a column."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    text = lambda x: py_strip(single_spaces(F.regexp_replace(x, r"(?s)<[^>]+>", "")))

    def cells(row, r):
        found = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
        return F.transform(found, lambda x, c: F.struct(r.cast("int").alias("r"), c.cast("int").alias("c"), text(x).alias("txt")))

    return F.filter(F.flatten(F.transform(rows, cells)), lambda x: x["txt"] != "")


def response_text(content: Column, parts: Column, reasoning: Column) -> Column:
    """Text of a chat answer: content, or its text parts joined; where that is blank, the reasoning. Stripped."""
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    text = py_strip(F.coalesce(content, joined, F.lit("")))
    return F.when(text != "", text).otherwise(py_strip(F.coalesce(reasoning, F.lit(""))))
