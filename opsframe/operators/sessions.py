"""Terminal sessions: gaps, offsets, audit summaries and typed commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.plans.ordered import Timeline


def _micros(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b)


def event_gaps(events: DataFrame, session: list[str], order: list[str], start: str, payload: str,
               rows_per_task: int | None = None) -> DataFrame:
    """gap: seconds since the session's previous event (4 decimals; from `start` for the first); bytes: payload size."""
    line = Timeline(events, session, order, rows_per_task).scan(previous={"_before": F.col(order[0])}).frame
    gap = _micros(F.coalesce("_before", start), F.col(order[0]))
    tenth_ms = F.floor((gap + 50) / 100)
    return line.withColumns({"gap": tenth_ms / F.lit(10000.0), "bytes": F.octet_length(payload).cast("long")}).drop("_before")


def session_offsets(chunks: DataFrame, session: list[str], time: str, rows_per_task: int | None = None) -> DataFrame:
    """offset: seconds since the first chunk of the session. Replay by ordering on (session, offset, sequence).

    The start is carried along the session's timeline: one shuffle, no join.
    """
    line = Timeline(chunks, session, [time], rows_per_task).scan(previous={"_has": F.lit(True)})
    line = line.scan(known={"_start": F.when(F.col("_has").isNull(), F.col(time))}).frame
    return line.withColumn("offset", _micros(F.col("_start"), F.col(time)) / F.lit(1e6)).drop("_start", "_has")


def in_session(events: DataFrame, sessions: DataFrame, by: list[str], time: str, seq: str, start: str, end: str,
               session_id: str, rows_per_task: int | None = None) -> DataFrame:
    """Events with the id of the session they fall into: the one of the same user started last, if not yet over.

    An as-of lookup on one timeline of session starts and events, not a join on the user.
    """
    marks = sessions.select(*by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_seq"),
                            F.struct(F.col(session_id).alias("id"), F.col(end).alias("until")).alias("_session"))
    rows = events.select(*by, F.col(time).alias("_at"), F.lit(1).alias("_kind"), F.col(seq).cast("long").alias("_seq"),
                         F.struct(*events.columns).alias("_row"))
    line = Timeline(marks.unionByName(rows, allowMissingColumns=True), by, ["_at", "_kind", "_seq"], rows_per_task)
    found = line.scan(known={"_in": F.col("_session")}).frame.filter("_kind = 1")
    inside = F.col("_in.until").isNull() | (F.col("_at") <= F.col("_in.until"))
    return found.filter(F.col("_in.id").isNotNull() & inside).select("_row.*", F.col("_in.id").alias(session_id))


def audit_summary(log: DataFrame, ttylog: DataFrame, filelog: DataFrame, execlog: DataFrame,
                  rows_per_task: int | None = None) -> DataFrame:
    """Per login: start, end, finished, duration, commands, files up and down, executions, hosts touched.

    Commands carry the log id; file and execution records belong to the user's session they fall into.
    """
    def within(df: DataFrame) -> DataFrame:
        return in_session(df, log, ["user"], "datetime", "id", "start_time", "end_time", "log_id", rows_per_task)

    commands = ttylog.groupBy("log_id").agg(F.count(F.lit(1)).alias("commands"))
    files = within(filelog).groupBy("log_id").agg(F.count_if(F.col("type") == "upload").alias("uploads"),
                                                  F.count_if(F.col("type") == "download").alias("downloads"))
    runs = within(execlog).groupBy("log_id").agg(F.count(F.lit(1)).alias("executions"), F.count_distinct("host").alias("hosts"))
    out = log.join(commands, "log_id", "left").join(files, "log_id", "left").join(runs, "log_id", "left")
    counts = ["commands", "uploads", "downloads", "executions", "hosts"]
    took = _micros(F.col("start_time"), F.col("end_time")) / F.lit(1e6)
    return out.fillna(0, counts).select("log_id", "user", "start_time", "end_time", "is_finished", took.alias("duration"), *counts)


# The full-screen switch, the shell and database prompts.
SCREEN_SWITCH = "\x1b\\[\\?1049"
SHELL_PROMPT = r"(?s)^.*@[^\n]*[$#]\s"
DATABASE_PROMPT = r"(?s)^.*mysql>\s"


def typed_command(text: Column, longest: int | None = None) -> Column:
    """What follows the last prompt, trimmed; the first `longest` characters where given."""
    prompt = F.when(text.rlike(SHELL_PROMPT), F.regexp_replace(text, SHELL_PROMPT, ""))
    rest = prompt.otherwise(F.regexp_replace(text, DATABASE_PROMPT, ""))
    whole = F.regexp_replace(rest, r"^\s+|\s+$", "")
    return F.substring(whole, 1, longest) if longest else whole


def extract_commands(chunks: DataFrame, session: list[str], order: list[str], output: str, typed: str,
                     rows_per_task: int | None = None, longest: int | None = None) -> DataFrame:
    """Commands typed outside a full-screen editor.

    A row with exactly two switches leaves the editor, one or three and more toggle it, and none leaves
    the state alone. So the state is the parity of the toggles since the last row with two: running
    toggles now minus running toggles at that row.
    """
    marks = F.regexp_count(F.col(output), F.lit(SCREEN_SWITCH))
    rows = chunks.withColumn("_marks", marks)
    toggles = F.when((F.col("_marks") > 0) & (F.col("_marks") != 2), 1).otherwise(0)
    line = Timeline(rows, session, order, rows_per_task).scan(running={"_toggles": toggles})
    line = line.scan(known={"_base": F.when(F.col("_marks") == 2, F.col("_toggles"))}).frame
    editing = (F.col("_toggles") - F.coalesce(F.col("_base"), F.lit(0))) % 2 == 1
    kept = line.filter((F.col("_marks") == 0) & ~editing)
    return kept.select(*session, *order, typed_command(F.col(typed), longest).alias("cmd"))
