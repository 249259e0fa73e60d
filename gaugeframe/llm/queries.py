"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import debruijn, decontaminate, embedding_dedup, hard_negatives, jaccard, licenses, line_dedup, mixing, quality, search, suffix_dedup, toxicity, url_filter
from .common import read


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.digest(suffix_dedup.cut(read(spark, sf_dir, "documents"), spark))


def op2_url_filter(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op3_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), spark)


def op4_toxicity(spark, sf_dir):
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), spark)


def op5_decontamination(spark, sf_dir):
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), spark)


def op6_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, spark).select("doc_id", "source", "mix_phase", "mix_block", "mix_slot", "mix_position")


def op7_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents"), spark)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), spark)


def op9_jaccard_join(spark, sf_dir):
    return jaccard.classes(read(spark, sf_dir, "documents"), spark).select("doc_id", "n_shingles", "component_id")


def op10_license_scan(spark, sf_dir):
    return licenses.scan(read(spark, sf_dir, "documents"), spark)


def op11_lexical_search(spark, sf_dir):
    return search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), spark)


def op12_substring_dedup(spark, sf_dir):
    return debruijn.digest(debruijn.cut(read(spark, sf_dir, "documents"), spark))


def op13_hard_negatives(spark, sf_dir):
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), spark)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_quality, op4_toxicity, op5_decontamination, op6_mixing, op7_line_dedup, op8_embedding_dedup, op9_jaccard_join, op10_license_scan, op11_lexical_search, op12_substring_dedup, op13_hard_negatives)}
ORACLE_SQL = {"op2_url_filter": url_filter.oracle(), "op7_line_dedup": line_dedup.oracle(), "op8_embedding_dedup": embedding_dedup.oracle(), "op9_jaccard_join": jaccard.oracle(), "op10_license_scan": licenses.oracle(), "op11_lexical_search": search.oracle(), "op12_substring_dedup": debruijn.oracle(), "op13_hard_negatives": hard_negatives.oracle()}
