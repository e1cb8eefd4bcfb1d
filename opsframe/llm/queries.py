"""Registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import (
    contamination,
    lines,
    near,
    packing,
    passages,
    quality,
    repeats,
    rules,
    secrets,
    spelling,
    tokens,
    toxicity,
    whitening,
)
from opsframe.plans.session import ship_package

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_best_fit_packing")
def best_fit_packing(spark, folder):
    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_toxicity")
def toxic_documents(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_suffix_array_dedup")
def suffix_array_dedup(spark, folder):
    return repeats.repeats(table(spark, folder, "documents")).drop("removed")


@query("op4_near_duplicates")
def near_duplicates(spark, folder):
    return near.near_duplicates(table(spark, folder, "documents"))


@query("op5_benchmark_decontamination")
def decontamination(spark, folder):
    found = contamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("items")


@query("op6_quality_classifier")
def quality_classifier(spark, folder):
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_quality_rules", rules.rules_sql())
def quality_rules(spark, folder):
    return rules.judged(table(spark, folder, "documents")).drop("cleaned")


@query("op8_secret_scans")
def secret_scans(spark, folder):
    return secrets.digest(secrets.secrets(table(spark, folder, "documents")))


@query("op9_line_dedup", lines.LINE_DEDUP_SQL)
def line_dedup(spark, folder):
    return lines.line_dedup(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op10_repeated_phrases")
def repeated_phrases(spark, folder):
    return passages.without_passages(table(spark, folder, "documents"))


@query("op11_embedding_whitening")
def embedding_whitening(spark, folder):
    """A deviation that leaves a long, which only a table of very many vectors can give, is null here."""
    return whitening.whitened(table(spark, folder, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


@query("op12_spelling_variants")
def spelling_variants(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_token_counts")
def token_counts(spark, folder):
    return tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
