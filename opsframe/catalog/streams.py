"""Streaming queries: each runs a stream over the given tables to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.base import query, table
from opsframe.catalog.series import BUFFER, KINDS, SAMPLES, counters, rate
from opsframe.catalog.storage import ROUTE_SQL, ROUTES, TAGGED, TAILS, message_lines
from opsframe.plans.session import scratch
from opsframe.sources import writes
from opsframe.streaming import ingest as I
from opsframe.streaming import keyed as K
from opsframe.streaming import operators as T
from opsframe.streaming.logs import ship
from opsframe.streaming.updates import newest_updates, updates_to_end


def stream_of(spark, sf, name):
    """A table of the folder, one file or a folder of files, as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def in_two_batches(spark, rows, time, build):
    """The folder with all output of build(stream) over `rows`, the earlier and the later half of their time as a batch each."""
    out = scratch(spark, "stream-out")
    K.run_batches(build(in_halves(spark, rows, time)), out).awaitTermination()
    return out


def in_halves(spark, rows, time):
    """`rows` as a stream of two batches, the earlier and the later half of their time."""
    path = scratch(spark, "halves")
    ends = rows.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    later = F.lit(False) if ends.a is None else F.col(time) > F.lit(ends.a + (ends.b - ends.a) / 2)
    rows.where(~later).write.parquet(f"{path}/part=0")
    files = max(1, len(spark.read.schema(rows.schema).parquet(f"{path}/part=0").inputFiles()))
    rows.where(later).coalesce(files).write.parquet(f"{path}/part=1")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*")  # oldest files first


@query("t1_tail_tag_route", f"WITH {TAGGED} " + " UNION ALL ".join(
    f"SELECT '{r}' AS route, 'web01 ' || tag || ' ' || msg AS line FROM tagged WHERE {w}" for r, w in ROUTE_SQL.items()))
def tail_tag_route(spark, sf):
    out = scratch(spark, "routed")
    ship(spark, message_lines(spark, sf), TAILS, ROUTES, "web01", out).awaitTermination()
    return spark.read.schema("value string, route string").text(out).select("route", F.col("value").alias("line"))


RATED = [*KINDS.values(), *BUFFER]


@query("t2_streaming_rates", f"WITH {SAMPLES} SELECT host, event_id, " + ", ".join(
    f"{rate(c, '5.0')} AS {c}_rate" for c in RATED) + " FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)")
def streaming_rates(spark, sf):
    samples = counters(spark, sf).frame.select("host", "ts", "event_id", *RATED)
    samples = spark.read.parquet(writes.publish(samples, "samples"))
    out = in_two_batches(spark, samples, "ts", lambda s: K.streaming_rates(s, ["host"], ["ts", "event_id"], RATED, 5, keep=365 * K.DAY))
    return K.read_batches(spark, out).select("host", "event_id", *[f"{c}_rate" for c in RATED])


def link_rows(events):
    """Every event probes a link between its user's switch and another; errors also answer it.

    Nine event minutes count as one second, so that the events' gaps fit the time limits of links.
    """
    u = F.col("user_id")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    ts = start + F.make_dt_interval(secs=F.floor(F.timestamp_diff("MICROSECOND", start, F.col("ts")) / 540) / 1000000)
    ends = [(u % 8).alias("src"), ((u + 1 + u.bitwiseAND(F.lit(1)) * 6) % 8).alias("dst")]
    rows = events.select(*ends, ts.alias("ts"), "event_type", F.lit(1).cast("long").alias("n"), "event_id")
    kinds = F.when(F.col("event_type") == "error", F.array(F.lit("probe"), F.lit("seen"))).otherwise(F.array(F.lit("probe")))
    rows = rows.select("*", F.posexplode(kinds).alias("_p", "kind"))
    return rows.select("src", "dst", "ts", (F.col("event_id") * 2 + F.col("_p")).alias("seq"), "kind", "n")


PROBES_SQL = """p AS (SELECT user_id % 8 AS src, (user_id + 1 + (user_id & 1) * 6) % 8 AS dst, event_id, event_type,
      TIMESTAMP '2024-01-01' + to_microseconds(CAST(floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 540.0) AS BIGINT)) AS ts FROM events)"""


# One row of each pair after the other; a row's own link is `my`, its reverse `back`.
@query("t3_liveness_stream", f"""WITH RECURSIVE {PROBES_SQL},
    k AS (SELECT src, dst, ts, event_id * 2 AS seq, false AS seen FROM p UNION ALL SELECT src, dst, ts, event_id * 2 + 1, true FROM p WHERE event_type = 'error'),
    m AS MATERIALIZED (SELECT *, least(src, dst) AS lo, src > dst AS up, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ts, seq) AS i FROM k),
    r AS (SELECT DISTINCT lo, CAST(0 AS BIGINT) AS i, CAST(NULL AS TIMESTAMP) AS seen0, CAST(NULL AS TIMESTAMP) AS seen1, CAST(0 AS BIGINT) AS sent0, CAST(0 AS BIGINT) AS sent1,
        false AS aged0, false AS aged1, CAST(NULL AS VARCHAR) AS event FROM m
      UNION ALL SELECT lo, i,
        CASE WHEN up THEN seen0 WHEN seen THEN ts WHEN NOT gone THEN seen0 END, CASE WHEN NOT up THEN seen1 WHEN seen THEN ts WHEN NOT gone THEN seen1 END,
        CASE WHEN up THEN sent0 WHEN seen THEN 0 ELSE sent0 + 1 END, CASE WHEN NOT up THEN sent1 WHEN seen THEN 0 ELSE sent1 + 1 END,
        CASE WHEN up THEN aged0 OR (gone AND seen0 IS NOT NULL) ELSE aged0 AND NOT seen AND NOT gone END,
        CASE WHEN NOT up THEN aged1 OR (gone AND seen1 IS NOT NULL) ELSE aged1 AND NOT seen AND NOT gone END,
        CASE WHEN gone THEN 'delete' WHEN seen AND my IS NULL THEN 'add' END
      FROM (SELECT *, NOT seen AND my IS NOT NULL AND sent > 5 AND (ts > my + INTERVAL 10 SECOND OR aged) AS gone
        FROM (SELECT m.lo, m.i, m.up, m.seen, m.ts, seen0, seen1, sent0, sent1, aged0, aged1, CASE WHEN m.up THEN seen1 ELSE seen0 END AS my,
            CASE WHEN m.up THEN sent1 ELSE sent0 END + 1 AS sent, CASE WHEN m.up THEN aged1 ELSE aged0 END AS aged
          FROM r JOIN m ON m.lo = r.lo AND m.i = r.i + 1)))
    SELECT src, dst, ts, seq, event FROM r JOIN m USING (lo, i) WHERE event IS NOT NULL""")
def liveness_stream(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    out = in_two_batches(spark, events, "ts", lambda s: K.streaming_liveness(link_rows(s)))
    return K.read_batches(spark, out).where("NOT late").select("src", "dst", "ts", "seq", "event")


SILENCE = (K.LOST_PROBES + 1) * K.PROBE_PERIOD
# Before each row, and at the last watermark, the links whose time is over go: the one that is due first (`p`), then perhaps
# its reverse, which has aged. Side 0 is the link from lo to hi.
@query("t3_silent_links", f"""WITH RECURSIVE {PROBES_SQL},
    k AS (SELECT src, dst, epoch_us(ts) AS t, event_id * 2 AS seq, 0 AS kind FROM p UNION ALL SELECT src, dst, epoch_us(ts), event_id * 2 + 1, 1 FROM p WHERE event_type = 'error'),
    g AS (SELECT src, dst, t, seq, kind FROM k UNION ALL
      SELECT least(src, dst), greatest(src, dst), (SELECT max(t) // 1000 * 1000 - 60000000 FROM k), NULL, 2 FROM k GROUP BY 1, 2),
    m AS MATERIALIZED (SELECT *, least(src, dst) AS lo, greatest(src, dst) AS hi, src > dst AS up,
        row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY kind = 2, t, seq) AS i FROM g),
    r AS (SELECT DISTINCT lo, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS s0, CAST(NULL AS BIGINT) AS s1, CAST(0 AS BIGINT) AS n0, CAST(0 AS BIGINT) AS n1,
        CAST(NULL AS BIGINT) AS a0, CAST(NULL AS BIGINT) AS a1, CAST(NULL AS BIGINT) AS f0, CAST(NULL AS BIGINT) AS f1, CAST(NULL AS VARCHAR) AS event FROM m
      UNION ALL SELECT lo, i,
        CASE WHEN kind = 2 OR up THEN s0 WHEN kind = 1 THEN t WHEN NOT gone THEN s0 END, CASE WHEN kind = 2 OR NOT up THEN s1 WHEN kind = 1 THEN t WHEN NOT gone THEN s1 END,
        CASE WHEN kind = 2 OR up THEN n0 WHEN kind = 1 THEN 0 ELSE n0 + 1 END, CASE WHEN kind = 2 OR NOT up THEN n1 WHEN kind = 1 THEN 0 ELSE n1 + 1 END,
        CASE WHEN kind = 2 THEN a0 WHEN up THEN CASE WHEN gone AND s0 IS NOT NULL THEN t ELSE a0 END WHEN kind = 0 AND NOT gone THEN a0 END,
        CASE WHEN kind = 2 THEN a1 WHEN NOT up THEN CASE WHEN gone AND s1 IS NOT NULL THEN t ELSE a1 END WHEN kind = 0 AND NOT gone THEN a1 END,
        f0, f1, CASE WHEN gone THEN 'delete' WHEN kind = 1 AND my IS NULL THEN 'add' END
      FROM (SELECT *, kind = 0 AND my IS NOT NULL AND sent > {K.LOST_PROBES} AND (t > my + 10000000 OR aged) AS gone
        FROM (SELECT *, CASE WHEN up THEN s1 ELSE s0 END AS my, CASE WHEN up THEN n1 ELSE n0 END + 1 AS sent, CASE WHEN up THEN a1 ELSE a0 END IS NOT NULL AS aged
          FROM (SELECT lo, i, up, kind, t, n0, n1, f0, f1, CASE WHEN f0 IS NULL THEN s0 END AS s0, CASE WHEN f1 IS NULL THEN s1 END AS s1,
                CASE WHEN f0 IS NULL AND f1 IS NOT NULL AND s0 IS NOT NULL THEN f1 WHEN f0 IS NULL THEN a0 END AS a0,
                CASE WHEN f1 IS NULL AND f0 IS NOT NULL AND s1 IS NOT NULL THEN f0 WHEN f1 IS NULL THEN a1 END AS a1
            FROM (SELECT *, CASE WHEN p = 0 THEN fd WHEN second < t THEN second END AS f0, CASE WHEN p = 1 THEN fd WHEN second < t THEN second END AS f1
              FROM (SELECT *, CASE WHEN p = 0 THEN greatest(fd, s1 + {round(SILENCE * 1e6)}) WHEN p = 1 THEN greatest(fd, s0 + {round(SILENCE * 1e6)}) END AS raw,
                  CASE WHEN (p = 0 AND s1 IS NOT NULL) OR (p = 1 AND s0 IS NOT NULL) THEN raw END AS second
                FROM (SELECT *, CASE WHEN least(d0, d1) < t THEN least(d0, d1) END AS fd, CASE WHEN fd IS NULL THEN NULL WHEN d0 IS NOT NULL AND (d1 IS NULL OR d0 <= d1) THEN 0 ELSE 1 END AS p
                  FROM (SELECT m.lo, m.i, m.up, m.kind, m.t, s0, s1, n0, n1, a0, a1,
                      CASE WHEN s0 IS NULL THEN NULL WHEN a0 IS NULL THEN s0 + 10000000 ELSE greatest(a0, s0 + {round(SILENCE * 1e6)}) END AS d0,
                      CASE WHEN s1 IS NULL THEN NULL WHEN a1 IS NULL THEN s1 + 10000000 ELSE greatest(a1, s1 + {round(SILENCE * 1e6)}) END AS d1
                    FROM r JOIN m ON m.lo = r.lo AND m.i = r.i + 1))))))))
    SELECT src, dst, make_timestamp(t) AS ts, seq, event FROM r JOIN m USING (lo, i) WHERE event IS NOT NULL
    UNION ALL SELECT lo, hi, make_timestamp(f0), NULL, 'delete' FROM r JOIN m USING (lo, i) WHERE f0 IS NOT NULL
    UNION ALL SELECT hi, lo, make_timestamp(f1), NULL, 'delete' FROM r JOIN m USING (lo, i) WHERE f1 IS NOT NULL""")
def silent_links(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    out = in_two_batches(spark, events, "ts", lambda s: K.streaming_liveness(link_rows(s), silence=SILENCE, late_by="1 minute"))
    return K.read_batches(spark, out).where("NOT late").select("src", "dst", "ts", "seq", "event")


LINK_SQL = PROBES_SQL + """,
    s AS (SELECT src, dst, max(event_id * 2 + 1) AS seq, max(ts) AS last_seen FROM p WHERE event_type = 'error' GROUP BY 1, 2),
    u AS (SELECT s.src, s.dst, last_seen, count(p.event_id) AS unanswered FROM s LEFT JOIN p ON p.src = s.src AND p.dst = s.dst AND p.event_id * 2 > s.seq GROUP BY 1, 2, 3),
    g AS (SELECT *, last_seen + INTERVAL 10 SECOND < TIMESTAMP '2024-01-01 01:20:05' AND unanswered > 5 AS gone FROM u)"""


@query("t3_liveness_snapshot", f"""WITH {LINK_SQL} SELECT g.src, g.dst, date_trunc('second', g.last_seen) AS last_seen, g.unanswered,
    CASE WHEN g.gone THEN 'remove' WHEN r.gone THEN 'check' ELSE 'keep' END AS action
    FROM g LEFT JOIN g r ON r.src = g.dst AND r.dst = g.src""")
def liveness_snapshot(spark, sf):
    now = F.lit("2024-01-01 01:20:05").cast("timestamp_ntz")
    found = T.expired_now(link_rows(table(spark, sf, "events")), now)
    return found.withColumn("last_seen", F.date_trunc("second", "last_seen").cast("timestamp_ntz"))


LOCATIONS = "l AS (SELECT event_id, ts, user_id AS mac, event_type, event_id % 3 AS port, user_id % 8 AS switch FROM events)"


def locations(events):
    return events.select("event_id", "ts", F.col("user_id").alias("mac"), (F.col("event_id") % 3).alias("port"), (F.col("user_id") % 8).alias("switch"))


@query("t4_location_changes", f"""WITH {LOCATIONS}, p AS (SELECT *, lag(port) OVER w AS old_port, lag(switch) OVER w AS old_switch, row_number() OVER w AS rn
    FROM l WINDOW w AS (PARTITION BY mac ORDER BY ts, event_id)) SELECT event_id, mac, port, switch, old_port, old_switch FROM p
    WHERE rn = 1 OR port <> old_port OR switch <> old_switch""")
def location_changes(spark, sf):
    out = in_two_batches(spark, locations(table(spark, sf, "events")), "ts", lambda s: K.streaming_locations(
        s, ["mac"], ["ts", "event_id"], ["port", "switch"], keep=365 * K.DAY))
    return K.read_batches(spark, out).where("NOT late").select("event_id", "mac", "port", "switch", "old_port", "old_switch")


@query("t4_current_locations", f"WITH {LOCATIONS} SELECT mac, arg_max(port, event_id) AS port, arg_max(switch, event_id) AS switch FROM l GROUP BY 1")
def current_locations(spark, sf):
    return T.latest(locations(table(spark, sf, "events")), ["mac"], ["ts", "event_id"]).select("mac", "port", "switch")


PORTS = """p AS (SELECT event_id, user_id % 8 AS switch, event_id % 16 AS port, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'add' ELSE 'modify' END AS kind FROM events),
    last AS (SELECT switch, port, arg_max(kind, event_id) AS kind FROM p GROUP BY 1, 2)"""


def port_events(events):
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "add").otherwise("modify")
    return events.select("event_id", "ts", (F.col("user_id") % 8).alias("switch"), (F.col("event_id") % 16).alias("port"), kind.alias("kind"))


@query("t5_live_ports", f"WITH {PORTS} SELECT switch, port, kind FROM last WHERE kind <> 'delete'")
def live_ports(spark, sf):
    stream = port_events(stream_of(spark, sf, "events"))
    final = updates_to_end(T.port_states(stream, ["switch", "port"], ["ts", "event_id"]), ["switch", "port"])
    return T.live_ports(final, ["switch", "port"], ["ts", "event_id"]).select("switch", "port", "kind")


@query("t5_links_of_dead_ports", f"""WITH {PORTS}, l AS (SELECT DISTINCT user_id % 8 AS src_switch, event_id % 16 AS src_port, (user_id + 1) % 8 AS dst_switch, (event_id + 5) % 16 AS dst_port FROM events),
    dead AS (SELECT switch, port FROM last WHERE kind = 'delete')
    SELECT *, 'delete' AS event FROM l WHERE (src_switch, src_port) IN (SELECT (switch, port) FROM dead) OR (dst_switch, dst_port) IN (SELECT (switch, port) FROM dead)""")
def dead_links(spark, sf):
    events = table(spark, sf, "events")
    e, u = F.col("event_id"), F.col("user_id")
    links = events.select((u % 8).alias("src_switch"), (e % 16).alias("src_port"), ((u + 1) % 8).alias("dst_switch"), ((e + 5) % 16).alias("dst_port")).distinct()
    return T.links_of_dead_ports(links, port_events(events), ["switch", "port"], ["ts", "event_id"])


@query("t6_sessions", """SELECT user_id, CAST(ts AS DATE) AS day, min(ts) AS start_time, max(CASE WHEN event_type = 'purchase' THEN ts END) AS end_time,
    bool_or(event_type = 'purchase') AS is_finished FROM events GROUP BY 1, 2""")
def session_records(spark, sf):
    changed = T.session_updates(stream_of(spark, sf, "events"), ["user_id"], "ts", F.col("event_type") == "purchase", "1 day", "1 day")
    found = updates_to_end(changed, ["user_id", "span"])
    return found.select("user_id", F.col("start_time").cast("date").alias("day"), "start_time", "end_time", "is_finished")


# A session ends with a purchase, or falls silent for a day.
@query("t6_login_sessions", """WITH l AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS closed, lag(ts) OVER w AS before, lag(event_type) OVER w AS what FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR what = 'purchase' OR epoch_us(ts) - epoch_us(before) > 86400000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM l)
    SELECT user_id, min(ts) AS start_time, max(ts) AS last_time, max(CASE WHEN closed THEN ts END) AS end_time, bool_or(closed) AS is_finished, count(*) AS n FROM s GROUP BY user_id, no""")
def login_sessions(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    out = in_two_batches(spark, events, "ts", lambda s: K.login_sessions(s, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase"))
    return newest_updates(spark, out, ["user_id", "start_time"]).select("user_id", "start_time", "last_time", "end_time", "is_finished", "n")


PORT_EVENTS = "p AS (SELECT ts, user_id % 8 AS switch, event_id % 16 AS port, event_type FROM events)"


# The last watermark lies ten minutes behind the newest event; a delete that an add could still cancel isn't told yet.
@query("t5_link_takedowns", f"""WITH {PORT_EVENTS}, w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS at FROM events),
    dead AS (SELECT switch, port, ts FROM p d, w WHERE event_type = 'error' AND ts + INTERVAL 10 MINUTE < w.at
      AND NOT EXISTS (SELECT 1 FROM p a WHERE a.event_type = 'signup' AND a.switch = d.switch AND a.port = d.port AND a.ts > d.ts AND a.ts <= d.ts + INTERVAL 10 MINUTE)),
    l AS (SELECT ts AS seen, user_id % 8 AS src_switch, event_id % 16 AS src_port, (user_id + 1) % 8 AS dst_switch, (event_id + 5) % 16 AS dst_port FROM events)
    SELECT DISTINCT src_switch, src_port, dst_switch, dst_port, dead.ts, 'delete' AS event FROM dead JOIN l
      ON ((switch = src_switch AND port = src_port) OR (switch = dst_switch AND port = dst_port)) AND seen <= dead.ts AND seen >= dead.ts - INTERVAL 1 HOUR""")
def link_takedowns(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    e, u = F.col("event_id"), F.col("user_id")
    ends = [(u % 8).alias("src_switch"), (e % 16).alias("src_port"), ((u + 1) % 8).alias("dst_switch"), ((e + 5) % 16).alias("dst_port")]
    out = in_two_batches(spark, events, "ts", lambda s: T.link_takedowns(
        s.select("ts", *ends), port_events(s), ["switch", "port"], "ts", "1 hour", "10 minutes", "10 minutes"))
    return K.read_batches(spark, out).distinct()  # a link is told for each end


# Every fifth user is in the store before the stream starts. What a user wrote first is stored when an hour without a row of
# this user has passed; the last watermark lies ten minutes behind the newest event.
@query("s10_insert_stream", """WITH l AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL),
    s AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) >= 3600000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM l),
    f AS (SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts, max(ts) AS last FROM s WHERE no = 1 GROUP BY user_id)
    SELECT user_id, event_id, ts FROM f WHERE user_id % 5 <> 0 AND last + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)
    UNION ALL SELECT DISTINCT user_id, -1, TIMESTAMP '2023-01-01' FROM events WHERE user_id % 5 = 0""")
def insert_stream(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    store = scratch(spark, "store")
    old = events.where("user_id % 5 = 0").select("user_id").distinct()
    old.select("user_id", F.lit(-1).cast("long").alias("event_id"), F.lit("2023-01-01").cast("timestamp_ntz").alias("ts")).write.parquet(f"{store}/batch=-1")
    order = ["ts", "event_id"]
    first = I.first_writers(in_halves(spark, events, "ts"), ["user_id"], order, "1 hour", "10 minutes")
    I.ingest(first, store, ["user_id"], order).awaitTermination()
    return I.read_store(spark, store, events.schema)
