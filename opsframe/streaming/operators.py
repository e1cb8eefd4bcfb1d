"""Batch twins of the keyed streams, ports and their links, and sessions within spans."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.plans.ordered import Timeline
from opsframe.plans.session import cut, ship_package
from opsframe.streaming.keyed import LINK_TIMEOUT, LOST_PROBES, Takedowns, back_to, event_instant, packed, unpacked


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key; combined on the map side."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_g_{k}") for k in keys]).agg(row).select("_row.*")


# --- latest location -----------------------------------------------------------------------------

def changes(line: Timeline, values: list[str]) -> DataFrame:
    """Rows on which a value differs from the key's previous row, with the previous values as old_*."""
    seen = line.scan(previous={f"old_{v}": F.col(v) for v in values} | {"_has": F.lit(True)}).frame
    same = F.coalesce(F.col("_has"), F.lit(False))
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"old_{v}"))
    return seen.filter(~same).drop("_has")


# --- liveness ------------------------------------------------------------------------------------

LINK = ["src", "dst"]
AT = ["ts", "seq"]


def _link_flags(rows: DataFrame, timeout: float, losses: int, rows_per_task: int) -> DataFrame:
    """Rows that can change a link's state, with code = side of the pair + 2 * (0 seen, 1 lost, 2 lost and silent).

    rows: (src, dst, ts, seq, kind, n) with kind `seen` or `probe` (n probes sent). When a link was last
    seen and how many probes it left unanswered since do not depend on its state, so two scans give them.
    """
    probe, seen = F.col("kind") == "probe", F.col("kind") == "seen"
    line = Timeline(rows, LINK, AT, rows_per_task).scan(running={"_probes": F.when(probe, F.col("n")).otherwise(F.lit(0))},
                                                        known={"_seen": F.when(seen, F.col("ts"))})
    line = line.scan(known={"_base": F.when(seen, F.col("_probes"))}).frame
    silent = F.timestamp_diff("MICROSECOND", F.col("_seen"), F.col("ts")) > int(timeout * 1_000_000)
    lost = probe & (F.col("_probes") - F.col("_base") > losses)
    what = F.when(seen, 0).when(lost & silent, 2).when(lost, 1)
    side = F.when(F.col("src") > F.col("dst"), 1).otherwise(0)
    kept = line.withColumns({"code": side + 2 * what, "lo": F.least(*LINK), "hi": F.greatest(*LINK)})
    return kept.filter("code IS NOT NULL").drop("_probes", "_base", "_seen")


def _moves() -> tuple[np.ndarray, np.ndarray]:
    """Next state and event by (code, state); a pair's state is 3 * side 0 + side 1, each 0 gone, 1 live, 2 aged."""
    following, event = np.zeros((6, 9), dtype=np.int8), np.zeros((6, 9), dtype=np.int8)
    for code in range(6):
        for state in range(9):
            ends, side, what = [state // 3, state % 3], code % 2, code // 2
            if what == 0:
                event[code, state] = 1 if ends[side] == 0 else 0
                ends[side] = 1
            elif ends[side] == 2 or (ends[side] == 1 and what == 2):
                event[code, state], ends[side] = 2, 0
                ends[1 - side] = 2 if ends[1 - side] else 0
            following[code, state] = 3 * ends[0] + ends[1]
    return following, event


NEXT_STATE, STATE_EVENT = _moves()


def _chunk_ends(rows: pd.DataFrame) -> pd.DataFrame:
    """The state after the chunk for each of the nine states before it."""
    ends = np.arange(9)
    for code in rows.sort_values(AT)["code"].to_numpy():
        ends = NEXT_STATE[code][ends]
    return rows[["lo", "hi", "_chunk"]].head(1).assign(ends=[ends.astype("int32").tolist()])


def _chunk_starts(chunks: pd.DataFrame) -> pd.DataFrame:
    """Thread a pair's state, at first no link, through its chunks; one row per chunk."""
    chunks = chunks.sort_values("_chunk")
    state, starts = 0, []
    for ends in chunks["ends"]:
        starts.append(state)
        state = int(ends[state])
    return chunks[["lo", "hi", "_chunk"]].assign(start=np.array(starts, dtype="int32"))


def _chunk_events(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(AT)
    state, events = int(rows["start"].iloc[0]), []
    for code in rows["code"].to_numpy():
        events.append(STATE_EVENT[code, state])
        state = NEXT_STATE[code, state]
    rows = rows.assign(event=np.array(["", "add", "delete"])[events])
    return rows.loc[rows["event"] != "", [*LINK, *AT, "event"]]


def link_events(rows: DataFrame, timeout: float = LINK_TIMEOUT, losses: int = LOST_PROBES, rows_per_task: int = 500_000) -> DataFrame:
    """(src, dst, ts, seq, event): `add` when a link is seen first or again, `delete` when it is removed.

    A link goes at a probe that finds too many losses and either the time limit passed or the link
    aged; a removed link ages its live reverse. So the links of a pair form a machine of nine states.
    A hot pair is cut into chunks: each is run from all nine states, the small results are threaded
    to give every chunk its true first state, and the chunks then run on their own.
    """
    flags = _link_flags(rows, timeout, losses, rows_per_task)
    flags = cut(flags.select("lo", "hi", *LINK, *AT, "code"))
    kept = Timeline(flags, ["lo", "hi"], AT, rows_per_task)._rows
    key = "lo {0}, hi {0}".format(kept.schema["lo"].dataType.simpleString())
    hot = kept.filter("_chunk > 0").groupBy("lo", "hi", "_chunk").applyInPandas(_chunk_ends, f"{key}, _chunk bigint, ends array<int>")
    starts = hot.groupBy("lo", "hi").applyInPandas(_chunk_starts, f"{key}, _chunk bigint, start int")
    ready = kept.join(starts, ["lo", "hi", "_chunk"], "left").fillna(0, ["start"])
    out = ready.select(*LINK, *AT).schema.add("event", "string")
    return ready.groupBy("lo", "hi", "_chunk").applyInPandas(_chunk_events, out)


def expired_now(rows: DataFrame, now: Column, timeout: float = LINK_TIMEOUT, losses: int = LOST_PROBES) -> DataFrame:
    """Snapshot twin: links silent at `now` (remove), and live reverses of removed links (check)."""
    last = rows.filter("kind = 'seen'").groupBy(*LINK).agg(F.max(F.struct(*AT)).alias("_seen"))
    later = rows.filter("kind = 'probe'").join(last, LINK).filter(F.struct(*AT) > F.col("_seen"))
    lost = later.groupBy(*LINK).agg(F.sum("n").alias("unanswered"))
    state = last.join(lost, LINK, "left").fillna(0, ["unanswered"])
    silent = F.timestamp_diff("MICROSECOND", F.col("_seen.ts"), now) > int(timeout * 1_000_000)
    state = state.withColumn("gone", silent & (F.col("unanswered") > losses))
    reverse = state.filter("gone").select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(True).alias("_rev"))
    both = state.join(reverse, LINK, "left")
    action = F.when(F.col("gone"), "remove").when(F.col("_rev"), "check").otherwise("keep")
    return both.select(*LINK, F.col("_seen.ts").alias("last_seen"), "unanswered", action.alias("action"))


# --- ports and sessions --------------------------------------------------------------------------

def live_ports(events: DataFrame, keys: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """Ports whose last event is not a delete."""
    return latest(events, keys, order).filter(F.col(kind) != "delete")


def links_of_dead_ports(links: DataFrame, events: DataFrame, port: list[str], order: list[str], kind: str = "kind") -> DataFrame:
    """Delete events for links with an end on a port whose last event is a delete.

    links: (src_<port columns>, dst_<port columns>); each end is a semi-join on the dead ports.
    """
    dead = latest(events, port, order).filter(F.col(kind) == "delete")
    ends = [links.join(dead.select(*[F.col(p).alias(f"{side}_{p}") for p in port]), [f"{side}_{p}" for p in port], "left_semi")
            for side in ("src", "dst")]
    return ends[0].unionByName(ends[1]).distinct().withColumn("event", F.lit("delete"))


def link_takedowns(links: DataFrame, events: DataFrame, port: list[str], time: str, horizon: str, grace: str, late_by: str,
                   kind: str = "kind") -> DataFrame:
    """(src_<port>, dst_<port>, time, event): on streams, a `delete` of each link that a deleted port takes down.

    A link is a row of `links` (src_<port columns>, dst_<port columns>, time) seen at most `horizon` before the delete on
    one of its ends. An `add` of the port within `grace` after the delete cancels it, so it is told once the watermark
    (`late_by` behind the newest row of the slower input) has passed that time. Each port has its own state
    (`keyed.Takedowns`), so a link whose two ends were deleted at one instant is told for each, in the same batch.
    """
    ship_package(events.sparkSession)
    key = [f"x_key{i}" for i in range(len(port))]
    link = [f"{end}_{p}" for end in ("src", "dst") for p in port]

    def side(rows: DataFrame, columns: list[Column]) -> DataFrame:
        return rows.select(event_instant(rows, time).alias("x_time"), *columns).withWatermark("x_time", late_by)

    told = side(events, [*[F.col(p).alias(k) for k, p in zip(key, port)], F.col(kind).alias("x_what"), F.lit("").alias("x_link")])
    # with the time in it, Spark leaves the condition above the watermark, so that events of all kinds move it
    told = told.filter(F.coalesce(F.when(F.col("x_time").isNull(), ""), F.col("x_what")).isin("delete", "add"))
    each = F.array(*[F.struct(*[F.col(f"{end}_{p}").alias(k) for k, p in zip(key, port)]) for end in ("src", "dst")])
    seen = side(links, [F.lit("seen").alias("x_what"), packed(link).alias("x_link"), each.alias("x_ends")]).withColumn("x_end", F.explode("x_ends"))
    seen = seen.select("x_time", "x_end.*", "x_what", "x_link")
    rows = told.unionByName(seen).filter(reduce(lambda a, b: a & b, [F.coalesce(F.when(F.col("x_time").isNull(), False), F.col(k).isNotNull()) for k in key]))
    processor = Takedowns(micros(horizon), micros(grace))
    found = rows.withColumn("x_at", F.unix_micros("x_time")).groupBy(*key).transformWithStateInPandas(processor, processor.out, "append", "EventTime")
    found = found.withColumn("x_link", unpacked("x_link", links, link))
    return found.select("x_link.*", back_to(F.col("x_us"), events, time).alias(time), F.lit("delete").alias("event"))


def micros(interval: str) -> int:
    """Microseconds of an interval such as `10 minutes`."""
    return int(pd.Timedelta(interval) / pd.Timedelta(1, "us"))


def port_states(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last event per port (add, modify, delete). On a stream, `run_updates` emits the ports that a batch touches."""
    return latest(events, keys, order)


def sessions(events: DataFrame, session: list, time: str, closed: Column) -> DataFrame:
    """Opened, closed and finished per session; a session without a logout is open."""
    return events.groupBy(*session).agg(F.min(time).alias("start_time"), F.max(F.when(closed, F.col(time))).alias("end_time"),
                                        F.bool_or(closed).alias("is_finished"))


def session_updates(stream: DataFrame, session: list[str], time: str, closed: Column, span: str, late: str) -> DataFrame:
    """`sessions` within spans of time (column `span`, a start in UTC) on a stream, for `run_updates`.

    Gives a session's record whenever a batch changes it. Spark keeps a session, finished or not, until the watermark
    (`late` behind the newest row) passes its span, and drops rows that come after that.
    """
    rows = stream.withColumn("_event_time", event_instant(stream, time)).withWatermark("_event_time", late)
    found = sessions(rows, [*session, F.window("_event_time", span).alias("_span")], time, closed)
    return found.select(*session, F.col("_span.start").alias("span"), "start_time", "end_time", "is_finished")
