"""Row identity and tables written between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.plans.session import scratch

KEY = ["_key", "_more"]
KEY_TYPE = "_key long, _more long"


def _key(doc_id, text):
    """Two hashes of 64 bits: ids may be null or repeat over much of a table, so they tell nothing apart."""
    return F.xxhash64(doc_id, text).alias("_key"), F.xxhash64(F.lit("more"), doc_id, text).alias("_more")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, _id, _key, _more), a null text as the empty text.

    _key and _more are never null and identify a document by its id and its text: rows that repeat an id with
    another text are documents of their own, rows that repeat both share one result. _id only orders them: a whole number as
    such, 0 for null, an id of any other type as text, empty for null.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    number = isinstance(found.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if number else F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return found.select("doc_id", "text", order.alias("_id"),
                        *_key(F.col("doc_id"), F.col("text")))


def wrapped(docs: DataFrame) -> DataFrame:
    """(_row, _key, _more): whole rows beside their identity, so no column of theirs can clash with a helper's name."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.struct("*").alias("_row"), *_key(docs["doc_id"], text))


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read again: later steps survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_row_each(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_key, _more, text), each document once; and once more those that several rows repeat, from a table.

    Of `keyed` rows. What occurs in a document that is repeated occurs twice at least, however many rows repeat it, so
    the two together stand for all rows where only once or more often counts.
    """
    rows = docs.select(*KEY, "text")
    twice = saved(docs.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY), "repeated-rows")
    again = saved(rows.join(twice, KEY, "left_semi").groupBy(*KEY).agg(F.first("text").alias("text")), "repeated-rows")
    return rows.join(twice, KEY, "left_anti").unionByName(again), again


def let(value, body):
    """`body` applied to `value`, which is evaluated once per row."""
    return F.transform(F.array(value), body)[0]
