"""Aggregation and run results."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.base import query, table
from opsframe.operators import aggregates as A


@query("a1_group_by", """SELECT l_returnflag, l_linestatus, count(*) AS n,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, max(l_shipdate) AS last_shipped FROM lineitem GROUP BY 1, 2""")
def group_by(spark, sf):
    return A.aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], n="count(1)",
                       quantity="cast(sum(cast(l_quantity as decimal(18,2))) as double)", last_shipped="max(l_shipdate)")


@query("a2_row_count", "SELECT count(*) AS c FROM lineitem")
def count_rows(spark, sf):
    return A.row_count(table(spark, sf, "lineitem"), "c")


@query("a3_frequencies", """SELECT event_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM events GROUP BY 1""")
def frequency_table(spark, sf):
    return A.by_count(A.frequencies(table(spark, sf, "events"), "event_type"), "event_type")


@query("a3_most_and_least", """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, n, 'most' AS side FROM c WHERE n = (SELECT max(n) FROM c)
    UNION ALL SELECT user_id, n, 'least' FROM c WHERE n = (SELECT min(n) FROM c)""")
def extremes(spark, sf):
    counts = A.frequencies(table(spark, sf, "events"), "user_id").drop("share")
    most, least = A.extreme(counts), A.extreme(counts, most=False)
    return most.withColumn("side", F.lit("most")).unionByName(least.withColumn("side", F.lit("least")))


@query("a4_batches", """SELECT batch, count(*) AS size, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn) AS keys FROM (
    SELECT o_orderkey, rn, CAST(floor((rn - 1) / 7) AS BIGINT) AS batch FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)) GROUP BY batch""")
def batches(spark, sf):
    packed = A.batches(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 7, ["o_orderkey"])
    keys = F.array_join(F.transform("items", lambda i: i["o_orderkey"].cast("string")), ",")
    return packed.select("batch", F.size("items").cast("long").alias("size"), keys.alias("keys"))


@query("a5_unique_by", """SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (
    PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def unique_rows(spark, sf):
    events = table(spark, sf, "events").select("ts", "event_id", "user_id", "event_type")
    kept = A.unique_by(events, F.struct("user_id", F.lower("event_type")), ["ts", "event_id"])
    return kept.orderBy("ts", "event_id").select("event_id", "user_id", "event_type")


@query("a6_invert", """SELECT p_type, max(p_partkey) AS last_key, min(p_partkey) AS first_key FROM part GROUP BY 1""")
def invert(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    last = A.invert(part, "p_partkey", "p_type", ["p_partkey"]).withColumnRenamed("p_partkey", "last_key")
    first = A.first_key(part, "p_partkey", "p_type", ["p_partkey"]).withColumnRenamed("p_partkey", "first_key")
    return last.join(first, "p_type")


@query("a6_keys_of", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def all_keys(spark, sf):
    return A.keys_of(table(spark, sf, "orders"), "o_orderkey", "o_orderpriority", "1-URGENT")


@query("a7_merge_tables", """SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS segment FROM customer
    UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier""")
def merge(spark, sf):
    customer = table(spark, sf, "customer")
    base = customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    patch = customer.filter("c_acctbal > 5000").select("c_custkey", F.concat(F.upper("c_mktsegment"), F.lit("!")).alias("segment"))
    extra = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("segment"))
    return A.merge_tables([base, extra, patch], ["c_custkey"], ["segment"])


@query("a7_merge_maps", """SELECT event_id, 'kind=' || event_type || ',k=' || CAST(props->>'$.k' AS VARCHAR) || ',user=' || user_id AS merged FROM events""")
def merge_map_columns(spark, sf):
    base = F.create_map(F.lit("kind"), F.lit("?"), F.lit("user"), F.col("user_id").cast("string"))
    props = F.from_json("props", "map<string,string>")
    merged = A.merge_maps(base, props, F.create_map(F.lit("kind"), F.col("event_type")))
    fields = [F.concat(F.lit(f"{n}="), merged[n]) for n in ("kind", "k", "user")]
    return table(spark, sf, "events").select("event_id", F.concat_ws(",", *fields).alias("merged"))


# --- run results ---------------------------------------------------------------------------------

RUNS = """run AS (SELECT user_id AS host, event_id, ts, event_type <> 'error' AS reached,
    CASE event_type WHEN 'click' THEN 'shell' WHEN 'view' THEN 'command' WHEN 'signup' THEN 'copy' ELSE 'service' END AS module,
    event_id % 3 AS rc, event_id % 7 = 0 AS failed, event_id % 2 = 1 AS changed,
    CASE WHEN event_id % 4 = 0 THEN '' ELSE 'out ' || event_id END AS stdout,
    CASE WHEN event_id % 5 = 0 THEN 'err ' || event_id ELSE '' END AS stderr,
    CASE WHEN event_id % 11 = 0 THEN 'old syntax' END AS warnings, 'msg ' || event_id AS msg,
    CAST(floor(value * 1000) AS BIGINT) AS took FROM events)"""


def runs(spark, sf):
    e = F.col("event_id")
    module = F.when(F.col("event_type") == "click", "shell").when(F.col("event_type") == "view", "command").when(
        F.col("event_type") == "signup", "copy").otherwise("service")
    took = F.floor(F.col("value") * 1000)
    return table(spark, sf, "events").select(
        F.col("user_id").alias("host"), "event_id", "ts", (F.col("event_type") != "error").alias("reached"), module.alias("module"),
        (e % 3).alias("rc"), (e % 7 == 0).alias("failed"), (e % 2 == 1).alias("changed"),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("out "), e)).alias("stdout"),
        F.when(e % 5 == 0, F.concat(F.lit("err "), e)).otherwise("").alias("stderr"),
        F.when(e % 11 == 0, "old syntax").alias("warnings"), F.concat(F.lit("msg "), e).alias("msg"),
        F.col("ts").alias("start"), (F.col("ts") + F.make_dt_interval(secs=took / 1000000)).alias("end"))


OUTCOME = """done AS (SELECT *, CASE WHEN NOT reached THEN 'failed' WHEN module IN ('shell','command') THEN CASE WHEN rc = 0 THEN 'ok' ELSE 'failed' END
    WHEN failed THEN 'failed' ELSE 'ok' END AS status FROM run)"""


@query("a8_run_outcome", f"""WITH {RUNS}, {OUTCOME} SELECT host, event_id, status, CASE WHEN NOT reached THEN msg
    WHEN module IN ('shell','command') THEN stdout || stderr WHEN status = 'failed' THEN msg ELSE CAST(changed AS VARCHAR) END AS detail FROM done""")
def outcomes(spark, sf):
    return A.run_outcomes(runs(spark, sf)).select("host", "event_id", "status", "detail")


@query("a8_outcome_counts", f"WITH {RUNS}, {OUTCOME} SELECT status, count(*) AS runs, count(DISTINCT host) AS hosts FROM done GROUP BY 1")
def counts_by_outcome(spark, sf):
    return A.outcome_counts(runs(spark, sf))


@query("a9_hosts_by_path", """SELECT DISTINCT r_name || '->' || n_name || '->' || c_mktsegment || '->' AS "group", c_name AS host
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def hosts(spark, sf):
    from opsframe.catalog.selection import assets
    return A.hosts_by_path(assets(spark, sf).withColumn("model", F.lit(None).cast("string")), ["r_name", "n_name", "c_mktsegment", "model"], "c_name")


@query("a9_host_lists", """SELECT grp AS "group", CAST(floor((rn - 1) / 4) AS BIGINT) AS part, string_agg(c_name, ',' ORDER BY rn) AS hosts FROM (
    SELECT r_name || '->' || c_mktsegment AS grp, c_name, row_number() OVER (PARTITION BY r_name, c_mktsegment ORDER BY c_name) AS rn
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY 1, 2""")
def host_lists(spark, sf):
    from opsframe.catalog.selection import assets
    rows = A.hosts_by_path(assets(spark, sf), ["r_name", "c_mktsegment"], "c_name")
    parts = A.in_parts(rows, ["group"], ["host"], 4, ["host"])
    return parts.select("group", "part", F.array_join(F.transform("items", lambda i: i["host"]), ",").alias("hosts"))


@query("a10_run_views", f"""WITH {RUNS} SELECT event_id, host,
    CASE WHEN NOT reached THEN 'dark' WHEN stdout <> '' THEN 'stdout' WHEN stderr <> '' THEN 'stderr' END AS kind,
    CASE WHEN NOT reached THEN msg WHEN stdout <> '' THEN stdout WHEN stderr <> '' THEN stderr END AS result FROM run""")
def views(spark, sf):
    return A.run_views(runs(spark, sf)).select("event_id", "host", "kind", "result")


@query("a10_stderr_or_warnings", f"""WITH {RUNS} SELECT event_id, host, stderr, warnings FROM run
    WHERE reached AND (stderr <> '' OR coalesce(warnings, '') <> '')""")
def noisy(spark, sf):
    return A.stderr_or_warnings(runs(spark, sf)).select("event_id", "host", "stderr", "warnings")


@query("a10_durations", f"""WITH {RUNS} SELECT host, count(*) AS runs, CAST(sum(took) AS BIGINT) AS total_us, max(took) AS longest_us FROM run WHERE reached GROUP BY 1""")
def durations(spark, sf):
    return A.run_durations(runs(spark, sf))


@query("a11_play_summary", f"""WITH {RUNS}, {OUTCOME} SELECT host, count(*) FILTER (reached AND status = 'ok') AS ok,
    count(*) FILTER (reached AND status = 'failed') AS failures, count(*) FILTER (NOT reached) AS unreachable,
    count(*) FILTER (reached AND status = 'ok' AND changed) AS changed, CAST(0 AS BIGINT) AS skipped FROM done GROUP BY 1""")
def summary(spark, sf):
    return A.play_summary(runs(spark, sf))


@query("a11_results_in_parts", f"""WITH {RUNS}, {OUTCOME} SELECT host, CAST(floor((rn - 1) / 50) AS BIGINT) AS part, count(*) AS n,
    string_agg(status, ',' ORDER BY rn) AS results FROM (SELECT host, status, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn FROM done) GROUP BY 1, 2""")
def results_in_parts(spark, sf):
    done = A.run_outcomes(runs(spark, sf)).select("host", "ts", "event_id", "status")
    parts = A.in_parts(done, ["host"], ["ts", "event_id"], 50, ["status"])
    return parts.select("host", "part", F.size("items").cast("long").alias("n"),
                        F.array_join(F.transform("items", lambda i: i["status"]), ",").alias("results"))


def _trim(p):
    return f"""max(us) FILTER (rn <= floor(n * {p} / 100)) AS max{p}, round(avg(us) FILTER (rn <= floor(n * {p} / 100)), 3) AS avg{p},
    round(stddev_pop(us) FILTER (rn <= floor(n * {p} / 100)), 3) AS std{p}"""


RESPONSE_SQL = f"""q AS (SELECT CAST(ts AS DATE) AS day, event_type, CAST(floor(value * 1000) AS BIGINT) AS us FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY day, event_type ORDER BY us) AS rn, count(*) OVER (PARTITION BY day, event_type) AS n FROM q),
    rt AS (SELECT day, event_type, avg(us) AS avg, {_trim(95)}, {_trim(99)} FROM r GROUP BY 1, 2)"""


@query("a12_response_times", f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, CAST(floor(value * 1000) AS BIGINT) AS us FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY day, event_type ORDER BY us) AS rn, count(*) OVER (PARTITION BY day, event_type) AS n FROM e)
    SELECT day, event_type, count(*) AS count, max(us) AS max, min(us) AS min, round(avg(us), 3) AS avg, median(us) AS med,
    round(stddev_pop(us), 3) AS std, {_trim(95)}, {_trim(99)} FROM r GROUP BY 1, 2""")
def response(spark, sf):
    events = table(spark, sf, "events").select(F.col("ts").cast("date").alias("day"), "event_type", F.floor(F.col("value") * 1000).alias("us"))
    times = A.response_times(events, ["day", "event_type"], "us")
    return times.withColumns({c: F.round(c, 3) for c in ("avg", "std", "avg95", "std95", "avg99", "std99")})


@query("a13_segment_use", """SELECT n_nationkey AS segment, n_name, count(c_custkey) AS total,
    CAST(coalesce(sum(c_custkey % 2), 0) AS BIGINT) AS assigned FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def utilisation(spark, sf):
    segments = table(spark, sf, "nation").select(F.col("n_nationkey").alias("segment"), "n_name")
    pool = table(spark, sf, "customer").select(F.col("c_nationkey").alias("segment"), (F.col("c_custkey") % 2).alias("assigned"))
    return A.segment_use(segments, pool, "segment")
