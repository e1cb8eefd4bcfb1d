"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder of the other tables) and returns a DataFrame; it is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`:

  quality           documents that the classifier scores below its threshold go
  line dedup        lines that ten documents or more share go; the documents stay, with n_chars of what is left
  near duplicates   of each group of near copies the document with the least id stays
  decontamination   documents that share ten consecutive words with a benchmark item go
  packing           tokenised, cut where longer than a sequence, and packed: a row for each piece
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from opsframe.llm import contamination, lines, near, packing, quality
from opsframe.llm.queries import table
from opsframe.llm.store import saved
from opsframe.plans.session import ship_package

TOKENIZER = "word_bpe_49k.json"
LINE_DOCUMENTS = 10


def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    return quality.good(docs, table(spark, folder, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    return lines.without_frequent_lines(docs, LINE_DOCUMENTS)


def near_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    return near.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    return contamination.clean(docs, table(spark, folder, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    ship_package(spark)
    return packing.packed(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: No SQL: a trained classifier and a tokenizer take part.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, folder), name.replace(" ", "-"))
    return docs
