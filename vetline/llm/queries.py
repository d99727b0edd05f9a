"""The registered queries of this package: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from vetline.llm import (embedding_dedup, filter_audit, forest_search, language_id, line_dedup, main_text, mixing, packing, simhash, spelling, suffix_dedup,
                         token_counts, toxicity)
from vetline.llm.common import table
from vetline.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
    return fn


@query
def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op9_mix_to_targets(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shards")


ORACLES["op9_mix_to_targets"] = mixing.ORACLE


@query
def op7_line_dedup(spark, sf_dir):
    return line_dedup.judged_lines(table(spark, sf_dir, "documents")).drop("row_id")


@query
def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query
def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings")).drop("recall")


ORACLES["op1_embedding_dedup"] = embedding_dedup.ORACLE


@query
def op2_forest_search(spark, sf_dir):
    return forest_search.nearest(table(spark, sf_dir, "embeddings"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_main_text(spark, sf_dir):
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op12_filter_audit(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op12_filter_audit"] = filter_audit.ORACLE


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
