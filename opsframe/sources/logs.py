"""Log lines: reading, tagging, formatting, routing and forwarding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.plans.session import ship_package
from opsframe.sources.tail import TailLines

# Syslog severities and facilities in numeric order (RFC 5424).
SEVERITIES = ["emerg", "alert", "crit", "error", "warning", "notice", "info", "debug"]
SEVERITY_ALIASES = {"panic": "emerg", "err": "error", "warn": "warning"}
FACILITIES = ["kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp",
              "ntp", "audit", "console", "cron2", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7"]


def severity_number(name: str) -> int:
    return SEVERITIES.index(SEVERITY_ALIASES.get(name, name))


@dataclass(frozen=True)
class TailRule:
    """Lines of files whose path matches `path` (regular expression) get this tag, severity and facility."""

    path: str
    tag: str
    severity: str = "info"
    facility: str = "local6"


def tag_lines(lines: DataFrame, rules: list[TailRule], file: str = "file") -> DataFrame:
    """Add tag, severity and facility numbers by file path; lines of other files are left out.

    The rules are a short configuration list and become one expression: no join.
    """
    def pick(value) -> Column:
        return F.coalesce(*[F.when(F.col(file).rlike(r.path), F.lit(value(r))) for r in rules])

    tagged = lines.withColumns({"tag": pick(lambda r: r.tag), "severity": pick(lambda r: severity_number(r.severity)),
                                "facility": pick(lambda r: FACILITIES.index(r.facility))})
    return tagged.filter("tag IS NOT NULL")


def read_lines(spark: SparkSession, path: str, rules: list[TailRule]) -> DataFrame:
    """Batch form of `tail_lines`."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    return tag_lines(lines.select(F.col("value").alias("msg"), F.col("_metadata.file_path").alias("file")), rules)


def tail_lines(spark: SparkSession, path: str, rules: list[TailRule], max_files: int | None = None) -> DataFrame:
    """Stream of the lines of new files, each of which is read once and must be whole (see `follow_lines`).

    The stream's checkpoint remembers what was read; `max_files` bounds a batch.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(path).select(F.col("value").alias("msg"), F.col("_metadata.file_path").alias("file"))
    return tag_lines(lines, rules)


def follow_lines(spark: SparkSession, path: str, rules: list[TailRule], **options) -> DataFrame:
    """Stream of the lines appended to files below `path`, tagged: files grow, are rotated, cut and removed meanwhile.

    Columns msg, file, at (the line's first byte) and the tags; options as for `TailLines`. `tail_lines` reads each file
    once instead, from any store that Spark's own readers reach.
    """
    ship_package(spark)
    spark.dataSource.register(TailLines)
    lines = spark.readStream.format("tail_lines").options(path=path, **options).load()
    return tag_lines(lines.withColumnRenamed("value", "msg"), rules)


def selector(text: str, facility: Column, severity: Column) -> Column:
    """`fac.sev;fac.none;...`: that severity or worse, `*` for any, `.none` to leave a facility out."""
    hit, out = F.lit(False), F.lit(False)
    for part in text.split(";"):
        fac, sev = part.strip().rsplit(".", 1)
        covers = F.lit(True) if fac == "*" else facility.isin([FACILITIES.index(f.strip()) for f in fac.split(",")])
        if sev == "none":
            out = out | covers
        elif sev == "*":
            hit = hit | covers
        else:
            hit = hit | (covers & (severity <= severity_number(sev)))
    return hit & ~out


def route(messages: DataFrame, routes: dict[str, str]) -> DataFrame:
    """One row per message and route whose selector matches. Selectors become one array expression: no join."""
    names = [F.when(selector(s, F.col("facility"), F.col("severity")), F.lit(name)) for name, s in routes.items()]
    return messages.withColumn("route", F.explode(F.array_compact(F.array(*names))))


def format_line(priority: Column, time: Column, host: Column, app: Column, procid: Column, msgid: Column, tag: Column, msg: Column) -> Column:
    """`<PRI>time host app procid msgid tag msg`, with a blank before the message unless it brings one."""
    gap = F.when(msg.startswith(" "), F.lit("")).otherwise(F.lit(" "))
    head = F.concat_ws(" ", F.concat(F.lit("<"), priority.cast("string"), F.lit(">"), time), host, app, procid, msgid, tag)
    return F.concat(head, gap, msg)


def priority(facility: Column, severity: Column) -> Column:
    return facility * 8 + severity


def plain_line(host: Column, tag: Column, msg: Column) -> Column:
    return F.concat_ws(" ", host, tag, msg)


def topic_rows(messages: DataFrame, topic: str, body: str = "msg", key: str | None = None) -> DataFrame:
    """Rows in the shape of a topic sink: (topic, key, value)."""
    return messages.select(F.lit(topic).alias("topic"), (F.col(key) if key else F.lit(None)).cast("string").alias("key"),
                           F.col(body).cast("string").alias("value"))


def forward(messages: DataFrame, topic: str, sink: str = "kafka", body: str = "msg", key: str | None = None, trigger: dict | None = None, **options):
    """Send message bodies to a topic; returns the started query for a stream. The Kafka sink needs its connector.

    A stream runs until it has caught up unless `trigger` says otherwise; its checkpoint is an option as for any sink.
    """
    rows = topic_rows(messages, topic, body, key)
    if not messages.isStreaming:
        return rows.write.format(sink).options(**options).mode("append").save()
    return rows.writeStream.format(sink).options(**options).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def write_routes(routed: DataFrame, path: str, line: str = "line") -> None:
    """Lines as text, one folder per route."""
    routed.select("route", line).write.partitionBy("route").mode("append").text(path)
