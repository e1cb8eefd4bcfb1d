"""Tail, tag, route and write log lines as one stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.plans.session import scratch
from opsframe.sources.logs import TailRule, follow_lines, plain_line, route


def ship(spark: SparkSession, path: str, rules: list[TailRule], routes: dict[str, str], host: str, out: str,
         checkpoint: str | None = None, max_bytes: int | None = None, trigger: dict | None = None):
    """Start the stream: lines appended to the tailed files, routed, as text with one folder per route.

    The checkpoint plays the part of the state file, the trigger that of the poll interval.
    """
    lines = route(follow_lines(spark, path, rules, **({"maxBytes": max_bytes} if max_bytes else {})), routes)
    shaped: DataFrame = lines.select("route", plain_line(F.lit(host), F.col("tag"), F.col("msg")).alias("value"))
    writer = shaped.writeStream.format("text").partitionBy("route").option("path", out)
    writer = writer.option("checkpointLocation", checkpoint or scratch(spark, "ship"))
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
