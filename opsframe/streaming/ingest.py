"""Insert-or-ignore on a stream: rows arrive in any order and more than once, the store keeps the first of each key.

Repeats of a key within `horizon` of each other merge in Spark's own session windows, whose state is one row per open key:
the row that is first by event time wins, not the one that arrived first. It goes on once the watermark has passed the
session, and its batch leaves out the keys that earlier batches stored. So state is bounded by the keys of a horizon,
while the store remembers for ever.

The store is a folder per batch. A batch that is run again reads the folders before its own and overwrites its own, so it
leaves the same rows. Rows with a null in their key never conflict: each is stored as it comes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from opsframe.plans.session import scratch
from opsframe.sources.inventory import read_facts
from opsframe.sources.writes import new_rows
from opsframe.streaming.keyed import event_instant, state_settings


def first_writers(stream: DataFrame, keys: list[str], order: list[str], horizon: str, late_by: str) -> DataFrame:
    """The first row by `order` (event time, then ties) of each key and session, and all rows whose key holds a null."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rows = stream.withColumn("_event_time", event_instant(stream, order[0])).withWatermark("_event_time", late_by)
    row = F.min_by(F.struct(*stream.columns), F.struct(*order)).alias("_row")
    # with the time in it, Spark leaves the condition above the watermark, which is that of all rows
    keyed = rows.filter(F.coalesce(F.when(F.col("_event_time").isNull(), False), whole))
    first = keyed.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.session_window("_event_time", horizon)).agg(row)
    return first.select("_row.*").unionByName(stream.filter(~whole))


def ingest(first: DataFrame, store: str, keys: list[str], order: list[str], checkpoint: str | None = None, trigger: dict | None = None):
    """Start the query that adds the rows of `first_writers` to the folders below `store`.

    `store` holds batch=<number> folders; rows that are there before the stream starts lie in batch=-1.
    """
    schema = first.schema

    def on_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stored = read_store(spark, store, schema, before=number)
        new_rows(batch, stored, keys, order).write.mode("overwrite").parquet(f"{store}/batch={number}")

    with state_settings(first.sparkSession):
        writer = first.writeStream.outputMode("append").foreachBatch(on_batch)
        writer = writer.option("checkpointLocation", checkpoint or scratch(first.sparkSession, "ingest"))
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_store(spark: SparkSession, store: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The rows of a store, or of its batches before one; none where the folder doesn't exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", IntegerType())).parquet(store)
    return (rows if before is None else rows.filter(F.col("batch") < before)).drop("batch")


def ingest_facts(lines: DataFrame, text: str, time: str, store: str, horizon: str, late_by: str, **options):
    """Host facts as they arrive: `host => {json}` lines with their time, stored once per product_uuid."""
    stamp: Column = F.col(time)
    facts = read_facts(lines, text, stamp).drop(text)
    order = [time, *[c for c in lines.columns if c not in (text, time)]]
    return ingest(first_writers(facts, ["product_uuid"], order, horizon, late_by), store, ["product_uuid"], order, **options)
