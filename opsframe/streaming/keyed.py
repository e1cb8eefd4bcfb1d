"""Streams whose state Spark keeps per key: counter rates, latest locations, link liveness and sessions.

Each operator is a stateful processor on `transformWithStateInPandas`, keyed by host, address, pair of links or session
holder, with RocksDB state and event-time timers. A key's state is one row. It goes when event time has moved `keep` seconds past the
key's last row (for links and sessions also by rules of their own), so state is bounded by the keys of that time.
Spark sees BUCKETS groups, each with the keys of a hash and their rows of state: reading state, setting timers and handing
frames over cost milliseconds a group, which many keys share.

Rows of a key that come after newer ones were handled are late. They aren't used, and none vanish without a word: those
that Spark still hands over come out with `late` set, and those behind the watermark, `late_by` behind the newest row of
the trigger before, are in `behind_watermark`. The rows that one trigger brings for a bucket are held in one task, as columns;
bound a trigger by the source's own option (`maxFilesPerTrigger`, `maxBytes`) where keys are hot.

A row's other columns pass through the workers as one JSON text and come back in their types, so null stays null and long
numbers stay exact. The order columns mustn't be null.

Output goes to a folder per batch (`run_batches`), which a repeated batch overwrites with equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from opsframe.plans.session import scratch, ship_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
DAY = 86_400.0
BUCKETS = 512  # groups of keys; a checkpoint holds for one number


def event_instant(stream: DataFrame, time: str) -> Column:
    """A time column as an instant: watermarks take no others."""
    if stream.schema[time].dataType.typeName() != "timestamp_ntz":
        return F.col(time).cast("timestamp")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(time)))


def back_to(micros: Column, like: DataFrame, time: str) -> Column:
    """Microseconds since 1970 in the type of a time column."""
    if like.schema[time].dataType.typeName() != "timestamp_ntz":
        return F.timestamp_micros(micros)
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)"))


TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def packed(columns: list[str]) -> Column:
    """Columns as one JSON text."""
    return F.to_json(F.struct(*columns), TIMES)


def unpacked(text: str, like: DataFrame, columns: list[str]) -> Column:
    return F.from_json(F.col(text), like.select(*columns).schema, TIMES)


def keyed(stream: DataFrame, keys: list[str], order: list[str], late_by: str, processor: InOrder, more: dict[str, Column]) -> DataFrame:
    """`processor` over the rows per bucket of keys: the key as x_key, one JSON text, the time in microseconds as x_at, the
    other order columns as x_t0, ..., and `more`.

    The workers get names of our own, as Spark renames columns that can't be names in Python.
    """
    ship_package(stream.sparkSession)
    own = {"x_bucket": F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"), "x_key": packed(keys)}
    own |= {f"x_t{i}": F.col(c) for i, c in enumerate(order[1:])} | more
    rows = stream.select(event_instant(stream, order[0]).alias("x_time"), *[c.alias(n) for n, c in own.items()])
    rows = rows.withColumn("x_at", F.unix_micros("x_time")).withWatermark("x_time", late_by)
    return rows.groupBy("x_bucket").transformWithStateInPandas(processor, processor.out, "append", "EventTime")


def types(df: DataFrame, columns: list[str]) -> list[str]:
    return [df.schema[c].dataType.simpleString() for c in columns]


def plain(value):
    """A state value in Python's own type."""
    return None if value is None else value.item() if isinstance(value, np.generic) else value


def together(parts: list[dict]) -> pd.DataFrame:
    """Output rows, each part a dict of arrays, or of lists where a value may be null."""
    def joined(values: list):
        if isinstance(values[0], np.ndarray):
            return np.concatenate(values)
        return pd.Series([v for part in values for v in part], dtype=object)

    return pd.DataFrame({c: joined([part[c] for part in parts]) for c in parts[0]})


class InOrder(StatefulProcessor):
    """The rows of each key of a bucket in order; the state holds a row a key: its last place and what a subclass keeps from row to row.

    `ties` are the types of the order columns after the time, kept with it. A row is late unless its place is behind the last.
    Between batches a timer is set that is no later than the first expiry of the bucket's keys.
    """

    def __init__(self, ties: list[str], kept_types: list[str], keep: float, out: str):
        self.place, self.keep_ms, self.out = ["x_at", *[f"x_t{i}" for i in range(len(ties))]], int(keep * 1000), out
        self.state = ", ".join(["x_key string", "x_at long", *[f"x_t{i} {t}" for i, t in enumerate(ties)], *kept_types])

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.state)

    def first_expiry(self, held: dict[str, tuple]) -> int | None:
        return min((self.expiry(v[0], v[len(self.place):]) for v in held.values()), default=None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {r[0]: tuple(r[1:]) for r in self.held.get()}
        timer = self.first_expiry(held)
        rows = pd.concat(list(rows), ignore_index=True)
        rows["x_no"] = pd.factorize(rows["x_key"])[0]
        rows = rows.sort_values(["x_no", *self.place], kind="stable")
        columns, places = {c: rows[c].to_numpy() for c in rows.columns}, [rows[c].array for c in self.place]
        begins = np.flatnonzero(np.diff(columns["x_no"], prepend=-1))
        found, late, n = [], [], len(places)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
            name, first = columns["x_key"][a], a
            before = held.get(name)
            while before is not None and a < b and tuple(p[a] for p in places) <= before[:n]:
                a += 1
            if a > first:
                late.append(self.told_late(name, {c: v[first:a] for c, v in columns.items()}))
            if a < b:
                told, kept = self.step(name, {c: v[a:b] for c, v in columns.items()}, None if before is None else before[n:])
                found.append(told)
                held[name] = (*(plain(p[b - 1]) for p in places), *kept)
        for parts in (late, found):
            if parts and len(told := together(parts)):
                yield told
        self.hold(held)
        if (due := self.first_expiry(held)) is not None and (timer is None or due < timer):
            self.handle.registerTimer(due)

    def hold(self, held: dict[str, tuple]) -> None:
        if held:
            self.held.put([(name, *v) for name, v in held.items()])
        else:
            self.held.clear()

    def step(self, name: str, rows: dict[str, np.ndarray], kept: tuple | None) -> tuple[dict, tuple]:
        """(output rows, what to keep) for a key's new rows in order."""
        raise NotImplementedError

    def told_late(self, name: str, rows: dict[str, np.ndarray]) -> dict:
        raise NotImplementedError

    def expiry(self, at: int, kept: tuple) -> int:
        return at // 1000 + 1 + self.keep_ms

    def expired(self, name: str, at: int, kept: tuple, now: int) -> tuple[dict | None, tuple | None]:
        """(output rows, what to keep) for a key whose time is over."""
        return None, None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drop the keys whose time is over, unless a subclass keeps them, and look again when the next one's is."""
        held = {r[0]: tuple(r[1:]) for r in self.held.get()}
        now, n, found = timerValues.getCurrentWatermarkInMs(), len(self.place), []
        over = [name for name, v in held.items() if self.expiry(v[0], v[n:]) <= now]
        for name in over:
            before = held.pop(name)
            told, kept = self.expired(name, before[0], before[n:], now)
            if told is not None:
                found.append(told)
            if kept is not None:
                held[name] = (*before[:n], *kept)
        if found and len(told := together(found)):
            yield told
        if over:
            self.hold(held)
        if held:
            self.handle.registerTimer(max(self.first_expiry(held), now + 1))

    def close(self) -> None:
        pass


# --- counter rates -------------------------------------------------------------------------------

class Rates(InOrder):
    """kept: the last value of each counter, then whether each was null."""

    def __init__(self, n: int, interval: float, *rest):
        super().__init__(*rest)
        self.n, self.interval = n, interval

    def step(self, name: str, rows: dict[str, np.ndarray], kept: tuple | None):
        out, last, missing = {"x_row": rows["x_row"]}, [], []
        for i in range(self.n):
            value, null = rows[f"x_v{i}"], rows[f"x_z{i}"]
            before = np.empty_like(value)
            before[0], before[1:] = value[0] if kept is None else kept[i], value[:-1]
            rate = (value - before) / self.interval
            if null.any() or kept is not None and kept[self.n + i]:
                rate[null] = np.nan  # becomes null
                rate[1:][null[:-1]] = np.nan
                if kept is not None and kept[self.n + i]:
                    rate[0] = np.nan
            out[f"x_r{i}"] = rate
            last.append(plain(value[-1]))
            missing.append(bool(null[-1]))
        return out | {"late": np.zeros(len(rows["x_row"]), bool)}, (*last, *missing)

    def told_late(self, name: str, rows: dict[str, np.ndarray]) -> dict:
        n = len(rows["x_row"])
        return {"x_row": rows["x_row"]} | {f"x_r{i}": np.full(n, np.nan) for i in range(self.n)} | {"late": np.ones(n, bool)}


def streaming_rates(samples: DataFrame, keys: list[str], order: list[str], counters: list[str], interval: float = 1.0,
                    late_by: str = "1 hour", keep: float = DAY) -> DataFrame:
    """The samples with <counter>_rate, (current - previous) / interval, 0 for a host's first sample, and `late`.

    Whole numbers are subtracted as such, other numbers as doubles. A null counter has no rate, nor has the one after it.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    kinds = ["long" if samples.schema[c].dataType.simpleString() in whole else "double" for c in counters]
    more = {"x_row": packed(samples.columns)}
    for i, (c, kind) in enumerate(zip(counters, kinds)):
        more |= {f"x_v{i}": F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)), f"x_z{i}": F.col(c).isNull()}
    kept = [*[f"x_v{i} {k}" for i, k in enumerate(kinds)], *[f"x_z{i} boolean" for i in range(len(counters))]]
    out = ", ".join(["x_row string", *[f"x_r{i} double" for i in range(len(counters))], "late boolean"])
    processor = Rates(len(counters), float(interval), types(samples, order[1:]), kept, keep, out)
    found = keyed(samples, keys, order, late_by, processor, more).withColumn("x_row", unpacked("x_row", samples, samples.columns))
    return found.select("x_row.*", *[F.col(f"x_r{i}").alias(f"{c}_rate") for i, c in enumerate(counters)], "late")


# --- latest location -----------------------------------------------------------------------------

class Locations(InOrder):
    """kept: the last place, as text."""

    def step(self, name: str, rows: dict[str, np.ndarray], kept: tuple | None):
        here = rows["x_here"].tolist()
        old = [None if kept is None else kept[0], *here[:-1]]
        moved = [i for i, (a, b) in enumerate(zip(here, old)) if a != b]
        return {"x_row": rows["x_row"][moved], "x_old": [old[i] for i in moved], "late": np.zeros(len(moved), bool)}, (here[-1],)

    def told_late(self, name: str, rows: dict[str, np.ndarray]) -> dict:
        n = len(rows["x_row"])
        return {"x_row": rows["x_row"], "x_old": [None] * n, "late": np.ones(n, bool)}


def streaming_locations(sightings: DataFrame, keys: list[str], order: list[str], values: list[str],
                        late_by: str = "1 hour", keep: float = 30 * DAY) -> DataFrame:
    """The sightings at which an address is new or has moved, with its place before as old_*, and late ones."""
    more = {"x_row": packed(sightings.columns), "x_here": packed(values)}
    processor = Locations(types(sightings, order[1:]), ["x_here string"], keep, "x_row string, x_old string, late boolean")
    found = keyed(sightings, keys, order, late_by, processor, more)
    found = found.withColumns({"x_row": unpacked("x_row", sightings, sightings.columns), "x_old": unpacked("x_old", sightings, values)})
    return found.select("x_row.*", *[F.col("x_old")[v].alias(f"old_{v}") for v in values], "late")


# --- link liveness -------------------------------------------------------------------------------

# Seconds without an answer, and unanswered probes, after which a link may go; seconds between probes.
LINK_TIMEOUT = 10.0
LOST_PROBES = 5
PROBE_PERIOD = 0.9


class Links(InOrder):
    """The two links of a pair; kept: for each when it was last seen (null: not live), its probes since, and when it aged."""

    def __init__(self, timeout: float, losses: int, silence: float | None, *rest):
        super().__init__(*rest)
        self.timeout, self.losses = int(timeout * 1e6), losses
        self.silence = None if silence is None else int(silence * 1e6)

    def remove(self, pair: list, side: int, at: int) -> None:
        pair[side], pair[4 + side] = None, None
        if pair[1 - side] is not None:
            pair[5 - side] = at

    def deadline(self, pair: list, side: int) -> int | None:
        """When a link goes without a row: `silence` after it was seen last, sooner where it has aged."""
        if self.silence is None or pair[side] is None:
            return None
        if pair[4 + side] is None:
            return pair[side] + max(self.timeout, self.silence)
        return max(pair[4 + side], pair[side] + self.silence)

    def gone(self, pair: list, before: int) -> Iterator[tuple[int, int]]:
        """Remove the links whose deadline lies before a time, in order: (side, deadline)."""
        while due := sorted((d, side) for side in (0, 1) if (d := self.deadline(pair, side)) is not None and d < before):
            at, side = due[0]
            self.remove(pair, side, at)
            yield side, at

    def told(self, name: str, events: list[tuple]) -> dict:
        """events: (side, time, seq, event)."""
        side, at, seq, event = (list(x) for x in zip(*events)) if events else ([], [], [], [])
        return {"x_key": [name] * len(events), "x_side": side, "_us": at, "seq": seq, "event": event, "late": [e == "late" for e in event]}

    def step(self, name: str, rows: dict[str, np.ndarray], kept: tuple | None):
        pair, events = list(kept or (None, None, 0, 0, None, None)), []
        for at, seq, side, kind, n in zip(*(rows[c].tolist() for c in ("x_at", "x_t0", "x_side", "x_kind", "x_n"))):
            events += [(other, due, None, "delete") for other, due in self.gone(pair, at)]
            if kind == "seen":
                if pair[side] is None:
                    events.append((side, at, seq, "add"))
                pair[side], pair[2 + side], pair[4 + side] = at, 0, None
            elif kind == "probe":
                pair[2 + side] += n
                if pair[side] is not None and pair[2 + side] > self.losses and (at - pair[side] > self.timeout or pair[4 + side] is not None):
                    self.remove(pair, side, at)
                    events.append((side, at, seq, "delete"))
        return self.told(name, events), tuple(pair)

    def told_late(self, name: str, rows: dict[str, np.ndarray]) -> dict:
        return self.told(name, [(side, at, seq, "late") for side, at, seq in zip(*(rows[c].tolist() for c in ("x_side", "x_at", "x_t0")))])

    def due(self, kept: tuple, at: int) -> int:
        """The millisecond at which the pair has to be looked at again."""
        ends = [d for side in (0, 1) if (d := self.deadline(list(kept), side)) is not None]
        if ends:
            return min(ends) // 1000 + 1
        return at // 1000 + 1 + self.keep_ms

    def expiry(self, at: int, kept: tuple) -> int:
        return self.due(kept, at)

    def expired(self, name: str, at: int, kept: tuple, now: int):
        pair = list(kept)
        events = [(side, due, None, "delete") for side, due in self.gone(pair, now * 1000)]
        over = self.due(tuple(pair), at) <= now and pair[0] is None and pair[1] is None
        return self.told(name, events), None if over else tuple(pair)


def streaming_liveness(rows: DataFrame, timeout: float = LINK_TIMEOUT, losses: int = LOST_PROBES, silence: float | None = None,
                       late_by: str = "1 hour", keep: float = DAY) -> DataFrame:
    """(src, dst, ts, seq, event, late) with event `add`, `delete` or, for a row that came too late, `late`.

    rows: (src, dst, ts, seq, kind, n), kind `seen` or `probe` (n probes sent). A link is added when it is seen first or
    again. It goes at a probe that finds more than `losses` unanswered and either `timeout` seconds passed or the link
    aged; a link that goes ages its live reverse. With `silence`, a link also goes without a row (seq is null): when event
    time passes the later of `timeout` and `silence` seconds since it was seen, an aged one `silence` seconds. Probes go out
    every PROBE_PERIOD seconds, so (losses + 1) * PROBE_PERIOD seconds are as many unanswered ones, recorded or not.
    A pair without live links is forgotten `keep` seconds after its last row; until then no late sighting revives it.
    """
    pairs = rows.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")})
    out = f"x_key string, x_side int, _us long, seq {rows.schema['seq'].dataType.simpleString()}, event string, late boolean"
    kept = ["seen0 long", "seen1 long", "sent0 long", "sent1 long", "aged0 long", "aged1 long"]
    processor = Links(timeout, losses, silence, types(rows, ["seq"]), kept, keep, out)
    more = {"x_side": (F.col("src") > F.col("dst")).cast("int"), "x_kind": F.col("kind"), "x_n": F.coalesce(F.col("n"), F.lit(0))}
    found = keyed(pairs, ["lo", "hi"], ["ts", "seq"], late_by, processor, more)
    found = found.withColumn("x_key", unpacked("x_key", pairs, ["lo", "hi"]))
    lo, hi, up = F.col("x_key.lo"), F.col("x_key.hi"), F.col("x_side") == 1
    return found.select(F.when(up, hi).otherwise(lo).alias("src"), F.when(up, lo).otherwise(hi).alias("dst"),
                        back_to(F.col("_us"), rows, "ts").alias("ts"), "seq", "event", "late")


# --- links of deleted ports ----------------------------------------------------------------------

class Takedowns(StatefulProcessor):
    """The deletes, adds and link sightings of a port, by which a delete takes down the links seen at most `horizon` before it
    unless an add follows within `grace`; it is told once the watermark has passed that time.

    A range as long as a bucket of time meets two neighbouring buckets, each from one side, so the first and the last add
    or sighting (of a link) in a bucket tell all: state and work don't grow with the pairs of a delete and a sighting.
    """

    out = "x_link string, x_us long"

    def __init__(self, horizon: int, grace: int):
        self.horizon, self.grace = horizon, grace
        self.spans = {"delete": 1, "add": grace, "seen": horizon}

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "what string, link string, lo long, hi long")

    def reduced(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        """(what, link, bucket, lo, hi) in order, a row per bucket."""
        rows = pd.concat(parts, ignore_index=True)
        rows["bucket"] = rows["lo"] // rows["what"].map(self.spans).astype("int64")
        return rows.groupby(["what", "link", "bucket"], as_index=False).agg({"lo": "min", "hi": "max"})

    def kept(self) -> pd.DataFrame:
        rows = pd.DataFrame([tuple(r) for r in self.held.get()], columns=["what", "link", "lo", "hi"])
        return rows.astype({"lo": "int64", "hi": "int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [self.kept()]
        for r in rows:
            parts.append(self.reduced([pd.DataFrame({"what": r["x_what"], "link": r["x_link"], "lo": r["x_at"], "hi": r["x_at"]})]).drop(columns="bucket"))
        yield from self.settle(self.reduced([p for p in parts if len(p)]), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.kept()
        if len(held):
            yield from self.settle(self.reduced([held]), timerValues.getCurrentWatermarkInMs() * 1000)

    def settle(self, held: pd.DataFrame, now: int) -> Iterator[pd.DataFrame]:
        """Tell the deletes that no add can cancel any more, and keep what can still count."""
        gone, back, seen = (held[held["what"] == w] for w in ("delete", "add", "seen"))
        at = gone["lo"].to_numpy()
        adds = back.set_index("bucket")
        same = adds["hi"].reindex(at // self.grace).to_numpy(dtype=object)
        after = adds["lo"].reindex(at // self.grace + 1).to_numpy(dtype=object)
        cancelled = np.array([(not pd.isna(h) and h > t) or (not pd.isna(a) and a <= t + self.grace) for h, a, t in zip(same, after, at)], bool)
        gone, at = gone[~cancelled], at[~cancelled]
        due = at + self.grace < now
        if due.any():
            told = pd.DataFrame({"x_us": at[due], "bucket": at[due] // self.horizon})
            here = told.merge(seen, on="bucket")
            before = told.assign(bucket=told["bucket"] - 1).merge(seen, on="bucket")
            found = pd.concat([here[here["lo"] <= here["x_us"]], before[before["hi"] >= before["x_us"] - self.horizon]])
            found = found[["link", "x_us"]].drop_duplicates().rename(columns={"link": "x_link"})
            if len(found):
                yield found
        gone = gone[~due]
        first = min(now, int(gone["lo"].min())) if len(gone) else now
        seen = seen[seen["hi"] >= first - self.horizon]
        held = pd.concat([gone, back[back["hi"] > now], seen])
        if not len(held):
            self.held.clear()
            return
        self.held.put([(w, k, int(lo), int(hi)) for w, k, lo, hi in zip(held["what"], held["link"], held["lo"], held["hi"])])
        end = int(gone["lo"].min()) + self.grace if len(gone) else int(held["hi"].max()) + self.horizon
        self.handle.registerTimer(end // 1000 + 1)

    def close(self) -> None:
        pass


# --- sessions ------------------------------------------------------------------------------------

class Sessions(InOrder):
    """kept: start of the open session (null: none), its rows, and the time of the last row."""

    def __init__(self, gap: float, *rest):
        super().__init__(*rest)
        self.gap = int(gap * 1e6)

    def told(self, name: str, records: list[tuple], late: bool = False) -> dict:
        """records: (start, last, end, finished, rows)."""
        start, last, end, finished, n = (list(x) for x in zip(*records))
        return {"x_key": [name] * len(records), "_start": start, "_last": last, "_end": end, "is_finished": finished, "n": n, "late": [late] * len(records)}

    def step(self, name: str, rows: dict[str, np.ndarray], kept: tuple | None):
        start, n, last = kept or (None, 0, None)
        records = []
        for at, closed in zip(rows["x_at"].tolist(), rows["x_closed"].tolist()):
            if start is not None and at - last > self.gap:
                records.append((start, last, None, False, n))
                start = None
            start, n, last = (at, 1, at) if start is None else (start, n + 1, at)
            if closed:
                records.append((start, at, at, True, n))
                start, n = None, 0
        if start is not None:  # as it stands, so that the record is there from the login on
            records.append((start, last, None, False, n))
        return self.told(name, records), (start, n, last)

    def told_late(self, name: str, rows: dict[str, np.ndarray]) -> dict:
        return self.told(name, [(at, at, None, False, 0) for at in rows["x_at"].tolist()], late=True)


def login_sessions(events: DataFrame, keys: list[str], order: list[str], closed: Column, gap: float = DAY,
                   late_by: str = "1 hour") -> DataFrame:
    """(keys, start_time, last_time, end_time, is_finished, n, late): sessions from login to logout, whatever day it is.

    A session begins with a holder's first row after a logout, or after `gap` seconds without one, and ends with the row for
    which `closed` holds. Its record comes whenever a batch changes it; the newest one per holder and start counts
    (`newest_updates`). One that only fell silent stays unfinished, and its state goes as event time passes the gap.
    """
    times = {"_start": "start_time", "_last": "last_time", "_end": "end_time"}
    out = ", ".join(["x_key string", *[f"{c} long" for c in times], "is_finished boolean", "n long", "late boolean"])
    processor = Sessions(gap, types(events, order[1:]), ["start long", "n long", "last long"], gap, out)
    found = keyed(events, keys, order, late_by, processor, {"x_closed": F.coalesce(closed, F.lit(False))})
    found = found.withColumn("x_key", unpacked("x_key", events, keys))
    return found.select("x_key.*", *[back_to(F.col(c), events, order[0]).alias(n) for c, n in times.items()], "is_finished", "n", "late")


# --- running -------------------------------------------------------------------------------------

@contextmanager
def state_settings(spark: SparkSession):
    """Settings for queries with state that start inside: RocksDB, and no more state partitions than cores, as each takes a
    task, with keyed state a Python worker too, in every batch. A query keeps a copy of them."""
    partitions = min(int(spark.conf.get(PARTITIONS)), max(1, spark.sparkContext.defaultParallelism))
    before = {name: spark.conf.get(name, None) for name in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(PARTITIONS, str(partitions))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_batches(result: DataFrame, out: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Start a query whose output of each batch goes to a folder of its own below `out`; its state is in RocksDB."""
    spark = result.sparkSession

    def on_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with state_settings(spark):
        writer = result.writeStream.outputMode("append").foreachBatch(on_batch)
        writer = writer.option("checkpointLocation", checkpoint or scratch(spark, "stream"))
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def behind_watermark(query) -> int:
    """The rows that a query of this run dropped because they came behind its watermark."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])


def state_rows(query) -> int:
    """The rows of state after the last batch."""
    return sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) if query.lastProgress else 0


def read_batches(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).drop("batch")
