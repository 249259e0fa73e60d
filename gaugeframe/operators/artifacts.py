"""Grading of HTML artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup


def count_elements(tags: Column, name: str) -> Column:
    """Start tags (markup.start_tags) of that name."""
    return F.size(F.filter(tags, lambda t: markup.tag_name(t) == name.lower()))


def count_class(tags: Column, name: str) -> Column:
    """Start tags with the class token."""
    has = lambda t: F.array_contains(F.split(markup.attribute(t, "class"), r"[ \t\n\r\f]+"), name)
    return F.size(F.filter(tags, lambda t: F.coalesce(has(t), F.lit(False))))


def text_content(tokens: Column, strict: bool = False) -> Column:
    """Text nodes joined by spaces, lower-cased; strict leaves out scripts and styles."""
    return F.lower(F.array_join(markup.texts(tokens, raw=not strict), " "))


def topics_found(text: Column, keywords: dict[str, list[str]]) -> list[Column]:
    """keywords_found, keywords_total, keywords_missing (in the order of the configuration)."""
    hit = lambda variants: F.exists(F.array(*[F.lit(v.lower()) for v in variants]), lambda v: F.contains(text, v)) if variants else F.lit(False)
    missing = F.filter(F.array(*[F.when(~hit(v), F.lit(t)) for t, v in keywords.items()]), lambda x: x.isNotNull()) if keywords else F.array().cast("array<string>")
    total = len(keywords)
    return [(total - F.size(missing)).alias("keywords_found"), F.lit(total).alias("keywords_total"), missing.alias("keywords_missing")]


def external_refs(tags: Column) -> Column:
    """Stylesheet links and scripts whose address starts with http:// or https://."""
    far = lambda t, name: F.coalesce(markup.attribute(t, name).rlike("^https?://"), F.lit(False))
    sheet = lambda t: (markup.tag_name(t) == "link") & F.coalesce(markup.attribute(t, "rel") == "stylesheet", F.lit(False)) & far(t, "href")
    return F.size(F.filter(tags, lambda t: sheet(t) | ((markup.tag_name(t) == "script") & far(t, "src"))))


def validate(artifacts: DataFrame, keywords: dict[str, list[str]], least: int, most: int, html: str = "html", element: str = "section", cls: str = "slide", strict: bool = False) -> DataFrame:
    """artifacts with parse_ok, has_doctype, slide_count, slide_count_ok, keywords_*, external_refs; a missing or empty one is all false and 0."""
    h = F.col(html)
    there = h.isNotNull() & (h != "")
    zero = lambda c: F.when(there, c).otherwise(F.lit(0))
    cut = artifacts.withColumn("_tokens", F.when(there, markup.tokens(h)))
    cut = cut.withColumns({"_tags": markup.start_tags(F.col("_tokens")), "_text": text_content(F.col("_tokens"), strict)})
    tags = F.col("_tags")
    found, total, missing = topics_found(F.col("_text"), keywords)
    out = cut.withColumns(
        {
            "parse_ok": there & F.coalesce(h.rlike(r"(?U)\S"), F.lit(False)),
            "has_doctype": F.coalesce(F.lower(F.regexp_replace(h, r"(?U)^[\s\x1c-\x1f]+", "")).startswith("<!doctype"), F.lit(False)),
            "slide_count": zero(F.greatest(count_class(tags, cls), count_elements(tags, element))),
            "keywords_found": zero(found),
            "keywords_total": F.when(there, total).otherwise(F.lit(0)),
            "keywords_missing": F.when(there, missing).otherwise(F.array().cast("array<string>")),
            "external_refs": zero(external_refs(tags)),
        }
    )
    return out.drop("_tokens", "_tags", "_text").withColumn("slide_count_ok", F.col("parse_ok") & F.col("slide_count").between(least, most))


def grade(validated: DataFrame, do_render: bool = False) -> DataFrame:
    """Adds auto_score, valid, keywords and note. With do_render, the input has rendered_ok, console_errors and render_note."""
    if not do_render:
        validated = validated.withColumns({"rendered_ok": F.lit(False), "console_errors": F.lit(0), "render_note": F.lit("skipped")})
    coverage = F.when(F.col("keywords_total") > 0, F.col("keywords_found") / F.col("keywords_total")).otherwise(F.lit(0.0))
    clean = F.col("rendered_ok") & (F.col("console_errors") == 0)
    score = F.lit(0.4) * coverage + F.lit(0.3) * F.col("slide_count_ok").cast("double") + F.lit(0.3) * clean.cast("double")
    notes = F.array(
        F.when(F.size("keywords_missing") > 0, F.concat(F.lit("missing topics: "), F.array_join("keywords_missing", ", "))),
        F.when(F.col("external_refs") > 0, F.concat(F.col("external_refs").cast("string"), F.lit(" external http ref(s) (not self-contained)"))),
        F.nullif(F.col("render_note"), F.lit("")),
    )
    return validated.withColumns(
        {
            "auto_score": F.bround(score, 3),
            "valid": F.col("parse_ok") & F.col("slide_count_ok") & (F.col("rendered_ok") | F.lit(not do_render)),
            "keywords": F.concat_ws("/", F.col("keywords_found").cast("string"), F.col("keywords_total").cast("string")),
            "console_errors": F.when(F.col("rendered_ok"), F.col("console_errors")),
            "note": F.array_join(F.filter(notes, lambda x: x.isNotNull()), "; "),
        }
    )


def merge_human(grades: DataFrame, human: DataFrame, key: str = "candidate") -> DataFrame:
    """grades with human_score (null if missing) and human_note ('' if missing)."""
    return grades.join(human.select(key, "human_score", "human_note"), key, "left").withColumn("human_note", F.coalesce("human_note", F.lit("")))
