"""Bounded samples of labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id):
    """Whether a document is kept from every fit: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def labelled(documents: DataFrame, labels: DataFrame, name: str, per_class: tuple[int, int], longest: int) -> tuple[list[str], list[int], float]:
    """Texts and labels of at most `per_class` documents of label 0 and 1 that aren't held out, and the share of label 1.

    The choice depends on doc_ids alone, so each run fits the same model. Texts of more than `longest` characters aren't
    used to fit (they are scored whole), and of an id with several texts one is taken, so the sample is bounded by
    sum(per_class) * longest characters. A label of null counts as none; an id with several labels has the largest.
    """
    one = labels.where(labels["doc_id"].isNotNull() & labels[name].isNotNull()).groupBy(labels["doc_id"].alias("doc_id")).agg(
        F.max(labels[name]).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    texts = documents.select(documents["doc_id"].alias("doc_id"), documents["text"].cast("string").alias("text"))
    short = texts.where(F.length("text") <= longest).select("doc_id")
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = one.join(short.distinct(), "doc_id")
    total = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    rows = []
    for label in (0, 1):
        chosen = known.where(F.col("label") == label).orderBy(order, "doc_id").limit(per_class[label])
        rows += texts.where(F.length("text") <= longest).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
            F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).orderBy("doc_id", "text").collect()
    n = sum(total.values())
    return [r.text for r in rows], [r.label for r in rows], total.get(1, 0) / n if n else 0.5
