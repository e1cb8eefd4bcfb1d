"""Metric series and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.aggregation import RESPONSE_SQL
from opsframe.catalog.base import query, table
from opsframe.operators import aggregates as A
from opsframe.operators import metrics as M
from opsframe.operators import sessions as S
from opsframe.plans.ordered import Timeline

KINDS = {"purchase": "Com_insert", "signup": "Com_update", "error": "Com_delete", "click": "Com_select", "view": "Bytes_sent"}
BUFFER = ["Innodb_buffer_pool_read_requests", "Innodb_buffer_pool_reads"]


def counters(spark, sf):
    """Cumulative counters per user: running sums over the user's events."""
    e, v = F.col("event_id"), F.floor("value")
    events = table(spark, sf, "events").select(F.col("user_id").alias("host"), "ts", "event_id", "event_type", "value")
    line = Timeline(events, ["host"], ["ts", "event_id"])
    sums = {c: F.when(F.col("event_type") == k, v).otherwise(F.lit(0)) for k, c in KINDS.items()}
    return line.scan(running=sums | {BUFFER[0]: e % 1000, BUFFER[1]: e % 10})


def by_host(expr):
    return f"sum({expr}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


SAMPLES = "s AS (SELECT user_id AS host, ts, event_id, " + ", ".join(
    by_host(f"CASE WHEN event_type = '{k}' THEN CAST(floor(value) AS BIGINT) ELSE 0 END") + f" AS {c}" for k, c in KINDS.items()
) + f", {by_host('event_id % 1000')} AS {BUFFER[0]}, {by_host('event_id % 10')} AS {BUFFER[1]} FROM events)"


def rate(c, interval):
    return f"coalesce(CAST({c} - lag({c}) OVER w AS DOUBLE), 0) / {interval}"


@query("w1_counter_rates", f"WITH {SAMPLES} SELECT host, event_id, " + ", ".join(
    f"{rate(c, '10.0')} AS {c}_rate" for c in [*KINDS.values(), *BUFFER]) + " FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)")
def counter_rates(spark, sf):
    names = [*KINDS.values(), *BUFFER]
    rates = M.counter_rates(counters(spark, sf), names, 10).frame
    return rates.select("host", "event_id", *[f"{c}_rate" for c in names])


# all sampled counters; the summands read the same in Spark and in the oracle
ALL_COUNTERS = {c: f"CASE WHEN event_type = '{k}' THEN CAST(floor(value) AS BIGINT) ELSE 0 END" for k, c in KINDS.items()} | {
    BUFFER[0]: "event_id % 1000", BUFFER[1]: "event_id % 10",
    "Innodb_rows_inserted": "event_id % 11", "Innodb_rows_updated": "event_id % 13", "Innodb_rows_deleted": "event_id % 17",
    "Innodb_rows_read": "event_id % 101", "Innodb_buffer_pool_pages_flushed": "event_id % 19",
    "Innodb_data_reads": "event_id % 23", "Innodb_data_writes": "event_id % 29",
    "Innodb_data_read": "200000 * (event_id % 97)", "Innodb_data_written": "150000 * (event_id % 89)",
    "Innodb_os_log_fsyncs": "event_id % 5", "Innodb_os_log_written": "40000 * (event_id % 47)",
    "Threads_created": "event_id % 3", "Bytes_received": "event_id % 1009"}


@query("w1_all_counter_rates", "WITH s AS (SELECT user_id AS host, ts, event_id, " + ", ".join(
    f"{by_host(x)} AS {c}" for c, x in ALL_COUNTERS.items()) + " FROM events) SELECT host, event_id, " + ", ".join(
    f"{rate(c, '10.0')} AS {c}_rate" for c in ALL_COUNTERS) + " FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)")
def all_counter_rates(spark, sf):
    rates = M.counter_rates(system_samples(spark, sf, ALL_COUNTERS), M.RATE_COUNTERS, 10).frame
    return rates.select("host", "event_id", *[f"{c}_rate" for c in M.RATE_COUNTERS])


@query("w2_statement_rates", f"""WITH {SAMPLES}, r AS (SELECT host, event_id, {rate('Com_insert', '1.0')} AS ins, {rate('Com_update', '1.0')} AS upd,
    {rate('Com_delete', '1.0')} AS del, {rate('Com_select', '1.0')} AS sel FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))
    SELECT *, ins + upd + del AS iud FROM r""")
def statement_rates(spark, sf):
    rates = M.counter_rates(counters(spark, sf), list(KINDS.values())).frame
    return M.statement_rates(rates).select("host", "event_id", "ins", "upd", "del", "sel", "iud")


@query("w3_hit_percent", f"""WITH {SAMPLES}, r AS (SELECT host, event_id, {rate(BUFFER[0], '1.0')} AS req, {rate(BUFFER[1], '1.0')} AS rd
    FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))
    SELECT host, event_id, CASE WHEN req > 0 THEN (req - rd) / req * 100 ELSE 100.0 END AS hit FROM r""")
def hit(spark, sf):
    rates = M.counter_rates(counters(spark, sf), BUFFER).frame
    return rates.select("host", "event_id", M.hit_percent(*[F.col(f"{c}_rate") for c in BUFFER]).alias("hit"))


# --- processor, disk, net ------------------------------------------------------------------------

TICKS = {"user": "CAST(floor(value) AS BIGINT)", "nice": "1", "system": "CAST(floor(value / 4) AS BIGINT)", "idle": "100",
         "iowait": "event_id % 7", "irq": "event_id % 2", "softirq": "event_id % 3"}
DISK = {"rd_ios": "event_id % 50", "rd_sectors": "8 * (event_id % 50)", "rd_ticks": "event_id % 40", "wr_ios": "event_id % 30",
        "wr_sectors": "16 * (event_id % 30)", "wr_ticks": "event_id % 60", "ticks": "event_id % 90", "aveq": "event_id % 20"}
NET = {"recv": "1000 * (event_id % 97)", "send": "10 * (event_id % 89)", "pswpin": "event_id % 5", "pswpout": "event_id % 2"}


def system_samples(spark, sf, *sets):
    """Cumulative system counters per user; the expressions read the same in Spark and in the oracle."""
    sums = {n: F.expr(x).cast("long") for group in sets for n, x in group.items()}
    events = table(spark, sf, "events").select(F.col("user_id").alias("host"), "ts", "event_id", "event_type", "value")
    return Timeline(events, ["host"], ["ts", "event_id"]).scan(running=sums)


def increments(*sets):
    """Differences of the running sums are the summands themselves; the window rebuilds them from the sums."""
    sums = ", ".join(f"{by_host(x)} AS {n}" for g in sets for n, x in g.items())
    diffs = ", ".join(f"CAST({n} - lag({n}, 1, 0) OVER w AS BIGINT) AS d_{n}" for g in sets for n in g)
    return f"""t AS (SELECT user_id AS host, ts, event_id, {sums} FROM events),
        d AS (SELECT host, event_id, ts, lag(ts) OVER w IS NULL AS first_sample, {diffs} FROM t WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))"""


CPU_SQL = """c AS (SELECT *, d_user + d_nice AS usr_t, d_system + d_irq + d_softirq AS sys_t, d_idle AS idl_t, d_iowait AS iow_t,
    d_user + d_nice + d_system + d_idle + d_iowait + d_irq + d_softirq AS all_t FROM d)"""


def percent_sql(n):
    return f"CAST(floor({n}_t / nullif(all_t, 0) * 100 + 0.5) AS BIGINT) AS {n}"


@query("w4_cpu_percent", f"WITH {increments(TICKS)}, {CPU_SQL} SELECT host, event_id, " + ", ".join(
    percent_sql(n) for n in ("usr", "sys", "idl", "iow")) + " FROM c")
def cpu(spark, sf):
    return M.cpu_percent(system_samples(spark, sf, TICKS)).frame.select("host", "event_id", "usr", "sys", "idl", "iow")


DISK_SQL = """m AS (SELECT *, 1000.0::DOUBLE * (usr_t + sys_t + idl_t + iow_t) / 4.0::DOUBLE / 100.0::DOUBLE AS ms FROM c),
    x AS (SELECT *, 1000.0::DOUBLE * d_rd_ios / ms AS rs, 1000.0::DOUBLE * d_wr_ios / ms AS ws, 1000.0::DOUBLE * d_rd_sectors / ms / 2 AS rkbs,
      1000.0::DOUBLE * d_wr_sectors / ms / 2 AS wkbs, d_aveq / ms AS queue,
      coalesce((d_rd_ticks + d_wr_ticks) / nullif(d_rd_ios + d_wr_ios, 0), 0) AS await,
      coalesce(d_ticks / nullif(d_rd_ios + d_wr_ios, 0), 0) AS svctm, least(100.0::DOUBLE, 100.0::DOUBLE * d_ticks / ms) AS util FROM m)"""


@query("w5_disk_rates", f"WITH {increments(TICKS, DISK)}, {CPU_SQL}, {DISK_SQL} SELECT host, event_id, " + ", ".join(
    f"round({n}, 6) AS {n}" for n in ("rs", "ws", "rkbs", "wkbs", "queue", "await", "svctm", "util")) + " FROM x")
def disk(spark, sf):
    out = M.disk_rates(M.cpu_percent(system_samples(spark, sf, TICKS, DISK)), M.elapsed_ms(4)).frame
    return out.select("host", "event_id", *[F.round(n, 6).alias(n) for n in ("rs", "ws", "rkbs", "wkbs", "queue", "await", "svctm", "util")])


@query("w6_traffic_rates", f"""WITH {increments(NET)} SELECT host, event_id,
    CASE WHEN first_sample THEN 0 ELSE d_recv / 2.0::DOUBLE END AS recv_rate, CASE WHEN first_sample THEN 0 ELSE d_send / 2.0::DOUBLE END AS send_rate,
    CASE WHEN first_sample THEN 0 ELSE CAST(floor(d_pswpin / 2.0) AS BIGINT) END AS pswpin_rate,
    CASE WHEN first_sample THEN 0 ELSE CAST(floor(d_pswpout / 2.0) AS BIGINT) END AS pswpout_rate FROM d""")
def traffic(spark, sf):
    out = M.traffic_rates(system_samples(spark, sf, NET), ["recv", "send"], ["pswpin", "pswpout"], 2).frame
    return out.select("host", "event_id", "recv_rate", "send_rate", "pswpin_rate", "pswpout_rate")


@query("w7_log_lag", """SELECT event_id, event_id % 100 AS history_list, event_id * 1000 + 999 - (event_id * 1000 + event_id % 777) AS unflushed_log,
    event_id * 1000 + 999 - event_id * 900 AS uncheckpointed_bytes, event_id % 8 AS queries_inside, event_id % 5 AS queries_queued,
    event_id % 3 AS read_views FROM events""")
def lag_of_log(spark, sf):
    e = F.col("event_id")
    text = F.format_string(
        "---\nLOG\n---\nLog sequence number %d\nLog flushed up to   %d\nLast checkpoint at  %d\nHistory list length %d\n"
        "%d queries inside InnoDB, %d queries in queue\n%d read views open inside InnoDB\n",
        e * 1000 + 999, e * 1000 + e % 777, e * 900, e % 100, e % 8, e % 5, e % 3)
    status = table(spark, sf, "events").select("event_id", text.alias("status"))
    return M.log_lag(status, "status").select("event_id", "history_list", "unflushed_log", "uncheckpointed_bytes",
                                              "queries_inside", "queries_queued", "read_views")


ALERT_LIMITS = [("usr", ">", "10"), ("sys", ">", "10"), ("iow", ">", "10"), ("pswpin_rate", ">", "0"), ("pswpout_rate", ">", "0"),
                ("recv_rate", ">", "1024"), ("send_rate", ">", "1024"), ("rkbs", ">", "1024"), ("wkbs", ">", "1024"),
                ("await", ">", "5"), ("svctm", ">", "5"), ("util", ">", "80")]


@query("w8_alerts", f"""WITH {increments(TICKS, DISK, NET)}, {CPU_SQL}, {DISK_SQL}, y AS (SELECT *, {percent_sql('usr')}, {percent_sql('sys')}, {percent_sql('iow')},
    CASE WHEN first_sample THEN 0 ELSE d_recv END AS recv_rate, CASE WHEN first_sample THEN 0 ELSE d_send END AS send_rate,
    CASE WHEN first_sample THEN 0 ELSE d_pswpin END AS pswpin_rate, CASE WHEN first_sample THEN 0 ELSE d_pswpout END AS pswpout_rate FROM x)
    """ + " UNION ALL ".join(f"SELECT host, event_id, '{m}' AS metric, '{m} {o} {lim}' AS msg, ts AS time, CAST(0 AS BIGINT) AS is_finished FROM y WHERE {m} {o} {lim}"
                             for m, o, lim in ALERT_LIMITS))
def alert_rows(spark, sf):
    line = M.cpu_percent(system_samples(spark, sf, TICKS, DISK, NET))
    line = M.traffic_rates(M.disk_rates(line, M.elapsed_ms(4)), ["recv", "send"], ["pswpin", "pswpout"])
    known = line.frame.columns
    rules = [r for r in M.RULES if r[0] in known and (not isinstance(r[2], str) or r[2] in known)]
    return M.alerts(line.frame, ["host", "event_id"], "ts", rules)


# busier hosts, so that each rule is met by some sample
BUSY = [TICKS | {"iowait": "event_id % 60"},
        DISK | {"rd_sectors": "80 * (event_id % 50)", "wr_sectors": "160 * (event_id % 30)", "ticks": "event_id % 900"},
        NET | {"send": "100 * (event_id % 89)"}]
GAUGES = {"load1": "event_id % 9", "load5": "event_id % 7", "load15": "event_id % 6", "ncpu": "4"}
STATUS = {c: ALL_COUNTERS[c] for c in (*BUFFER, "Innodb_data_read", "Innodb_data_written", "Innodb_os_log_written")}
ALL_LIMITS = [("load1", ">", "ncpu"), ("load5", ">", "ncpu"), ("load15", ">", "ncpu"), *ALERT_LIMITS,
              ("hit", "<=", "99"), ("Innodb_data_read_rate", ">", "9437184"), ("Innodb_data_written_rate", ">", "9437184"),
              ("Innodb_os_log_written_rate", ">", "1048576"), ("avg", ">", "10000"), ("avg95", ">", "10000"), ("avg99", ">", "10000")]


@query("w8_all_alerts", f"""WITH {increments(*BUSY, STATUS)}, {CPU_SQL}, {DISK_SQL}, {RESPONSE_SQL},
    y AS (SELECT x.*, {percent_sql('usr')}, {percent_sql('sys')}, {percent_sql('iow')},
    """ + ", ".join(f"CASE WHEN first_sample THEN 0 ELSE d_{c} END AS {c}_rate" for c in (*NET, *STATUS)) + ", " + ", ".join(
    f"{e.replace('event_id', 'x.event_id')} AS {g}" for g, e in GAUGES.items()) + f""", rt.avg, rt.avg95, rt.avg99
      FROM x JOIN events e ON e.event_id = x.event_id JOIN rt ON rt.day IS NOT DISTINCT FROM CAST(e.ts AS DATE) AND rt.event_type IS NOT DISTINCT FROM e.event_type),
    z AS (SELECT *, CASE WHEN {BUFFER[0]}_rate > 0 THEN ({BUFFER[0]}_rate - {BUFFER[1]}_rate) / {BUFFER[0]}_rate * 100.0::DOUBLE ELSE 100.0 END AS hit FROM y)
    """ + " UNION ALL ".join(f"SELECT host, event_id, '{m}' AS metric, '{m} {o} ' || {lim} AS msg, ts AS time, CAST(0 AS BIGINT) AS is_finished FROM z WHERE {m} {o} {lim}"
                             for m, o, lim in ALL_LIMITS))
def all_alert_rows(spark, sf):
    line = M.cpu_percent(system_samples(spark, sf, *BUSY, STATUS))
    line = M.traffic_rates(M.disk_rates(line, M.elapsed_ms(4)), ["recv", "send"], ["pswpin", "pswpout"])
    samples = M.counter_rates(line, list(STATUS)).frame.withColumns({g: F.expr(x) for g, x in GAUGES.items()} | {
        "hit": M.hit_percent(*[F.col(f"{c}_rate") for c in BUFFER]), "day": F.col("ts").cast("date")})
    keys = ["day", "event_type"]
    times = A.response_times(samples.select(*keys, F.floor(F.col("value") * 1000).alias("us")), keys, "us")
    times = times.select(*[F.col(k).alias(f"_{k}") for k in keys], "avg", "avg95", "avg99")
    both = samples.join(times, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return M.alerts(both, ["host", "event_id"], "ts")


# --- sessions ------------------------------------------------------------------------------------

@query("w9_event_gaps", """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), g AS (SELECT event_id, user_id, day, octet_length(CAST(props AS BLOB)) AS bytes,
    date_diff('microsecond', coalesce(lag(ts) OVER (PARTITION BY user_id, day ORDER BY ts, event_id), CAST(day AS TIMESTAMP)), ts) AS us FROM e)
    SELECT event_id, user_id, day, floor((us + 50) / 100) / 10000.0::DOUBLE AS gap, bytes FROM g""")
def gaps(spark, sf):
    day = F.col("ts").cast("date")
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "props", day.alias("day"), day.cast("timestamp_ntz").alias("start"))
    return S.event_gaps(events, ["user_id", "day"], ["ts", "event_id"], "start", "props").select("event_id", "user_id", "day", "gap", "bytes")


@query("w10_session_offsets", """SELECT event_id, user_id, day, date_diff('microsecond', min(ts) OVER (PARTITION BY user_id, day), ts) / 1e6 AS "offset"
    FROM (SELECT *, CAST(ts AS DATE) AS day FROM events)""")
def offsets(spark, sf):
    chunks = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("ts").cast("date").alias("day"))
    return S.session_offsets(chunks, ["user_id", "day"], "ts").orderBy("user_id", "day", "offset", "event_id").drop("ts")


LOG_SQL = """log AS (SELECT user_id * 100 + day // 7 AS log_id, user_id, min(ts) AS start_time,
    CASE WHEN user_id % 3 > 0 THEN greatest(min(ts), max(ts) - INTERVAL 2 HOUR) END AS end_time, user_id % 3 > 0 AS is_finished FROM (
      SELECT *, day(ts) AS day FROM events) GROUP BY user_id, day // 7)"""


def login_tables(spark, sf):
    """A login per user and week, from the user's first event to 2 h before the last; every third user stays logged in."""
    events = table(spark, sf, "events")
    week = F.floor(F.dayofmonth("ts") / 7)
    hours = F.expr("INTERVAL 2 HOURS")
    span = events.groupBy("user_id", week.alias("week")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    done = F.col("user_id") % 3 > 0
    log = span.select((F.col("user_id") * 100 + F.col("week")).alias("log_id"), F.col("user_id").alias("user"),
                      F.col("a").alias("start_time"), F.when(done, F.greatest("a", F.col("b") - hours)).alias("end_time"), done.alias("is_finished"))
    kind = F.col("event_type")
    tty = events.filter(kind == "click").select((F.col("user_id") * 100 + week).alias("log_id"), "ts")
    files = events.filter(kind.isin("purchase", "view")).select(
        F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("ts").alias("datetime"),
        F.when(kind == "purchase", "upload").otherwise("download").alias("type"))
    runs = events.filter(kind == "error").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"),
                                                 F.col("ts").alias("datetime"), (F.col("event_id") % 5).alias("host"))
    return log, tty, files, runs


@query("w11_audit_summary", f"""WITH {LOG_SQL},
    o AS (SELECT *, lead(start_time) OVER (PARTITION BY user_id ORDER BY start_time) AS next_start FROM log),
    x AS (SELECT log_id, event_type, event_id FROM o JOIN events e ON e.user_id = o.user_id AND e.ts >= start_time
          AND (next_start IS NULL OR ts < next_start) AND (end_time IS NULL OR ts <= end_time)),
    n AS (SELECT log_id, count(*) FILTER (event_type = 'purchase') AS uploads, count(*) FILTER (event_type = 'view') AS downloads,
          count(*) FILTER (event_type = 'error') AS executions, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id % 5 END) AS hosts FROM x GROUP BY 1),
    c AS (SELECT user_id * 100 + day(ts) // 7 AS log_id, count(*) AS commands FROM events WHERE event_type = 'click' GROUP BY 1)
    SELECT log.log_id, user_id AS "user", start_time, end_time, is_finished, date_diff('microsecond', start_time, end_time) / 1e6 AS duration,
    coalesce(commands, 0) AS commands, coalesce(uploads, 0) AS uploads, coalesce(downloads, 0) AS downloads,
    coalesce(executions, 0) AS executions, coalesce(hosts, 0) AS hosts FROM log LEFT JOIN n USING (log_id) LEFT JOIN c USING (log_id)""")
def audit(spark, sf):
    return S.audit_summary(*login_tables(spark, sf))


# ESC [ ? 1 0 4 9 occurs 1, 2 or 3 times in some of the turns
@query("w12_commands", """WITH c AS (SELECT conv_id, turn, text, CASE (conv_id + 2 * turn) % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS m FROM conversations),
    g AS (SELECT *, sum(CASE WHEN m = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM c),
    f AS (SELECT *, sum(CASE WHEN m IN (1, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, grp ORDER BY turn) % 2 AS editing FROM g)
    SELECT conv_id, turn, substr(regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g'), 1, 200) AS cmd FROM f WHERE m = 0 AND editing = 0""")
def commands(spark, sf):
    marks = (F.col("conv_id") + 2 * F.col("turn")) % 7
    times = F.when(marks == 0, 1).when(marks == 1, 2).when(marks == 3, 3).otherwise(0)
    line = F.translate("text", "\n", " ")
    prompt = F.when(F.col("turn") % 2 == 0, F.lit("[u@h ~]$ ")).otherwise(F.lit("mysql> "))
    chunks = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("screen "), F.repeat(F.lit("\x1b[?1049h"), times), "text").alias("output"),
        F.concat(prompt, line).alias("typed"))
    return S.extract_commands(chunks, ["conv_id"], ["turn"], "output", "typed", longest=200)
