"""Streaming aggregations whose changed rows go to a folder per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.plans.session import scratch


def run_updates(changed: DataFrame, out: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Start a streaming aggregation whose state Spark keeps; the rows that a batch changes go to its own folder."""
    def on_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = changed.writeStream.outputMode("update").foreachBatch(on_batch)
    writer = writer.option("checkpointLocation", checkpoint or scratch(changed.sparkSession, "stream"))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def newest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last row that `run_updates` wrote per key."""
    rows = spark.read.parquet(out)
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, "_last.*")


def updates_to_end(changed: DataFrame, keys: list[str]) -> DataFrame:
    """Process what the source holds now and return the last row per key."""
    out = scratch(changed.sparkSession, "stream-out")
    run_updates(changed, out).awaitTermination()
    return newest_updates(changed.sparkSession, out, keys)
