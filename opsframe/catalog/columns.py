"""Column functions as table jobs, and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.base import query, table
from opsframe.functions import records, report, text, user
from opsframe.sources.inventory import json_of


@query("c1_key_normalisation", """SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS bare,
    regexp_replace(c_name, '[^0-9]', '', 'g') AS number, CAST(c_name[10:] AS BIGINT) AS parsed, CAST(-1 AS BIGINT) AS not_parsed,
    regexp_replace(lower(c_name || ' ' || c_mktsegment), '[^a-z0-9_-]+', '-', 'g') AS slug, 'order_line_' || lower(c_mktsegment) AS snake,
    upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Group' AS title,
    regexp_replace(lpad(hex(c_custkey), 12, '0'), '(..)(..)(..)(..)(..)(..)', '\\1:\\2:\\3:\\4:\\5:\\6') AS mac, c_name AS round_trip FROM customer""")
def normalise(spark, sf):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    bare = text.strip_prefixes(name, ["Customer#", "Supplier#"])
    return table(spark, sf, "customer").select(
        "c_custkey", bare.alias("bare"), text.digits(name).alias("number"), text.int_or(bare).alias("parsed"),
        text.int_or(name, -1).alias("not_parsed"), text.slug(F.concat_ws(" ", name, seg)).alias("slug"),
        text.snake_case(F.concat(F.lit("OrderLine"), F.initcap(seg))).alias("snake"),
        text.title(F.concat(seg, F.lit("_group"))).alias("title"),
        text.hex_pairs(F.lpad(F.hex("c_custkey"), 12, "0")).alias("mac"), text.to_text(text.to_bytes(name)).alias("round_trip"))


@query("c2_report_format", """SELECT o_orderkey, format('{:,}', o_orderkey * 1000003) AS commas,
    CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd'
      WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal,
    regexp_replace(lpad(CAST(o_custkey AS VARCHAR), 10, '0'), '(...)(...)(....)', '(\\1) \\2-\\3') AS phone,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS filled_date, lower(to_base(o_orderkey * 7919, 36)) AS base36,
    CASE WHEN length(note) > 30 THEN substr(note, 1, 14) || '..' || right(note, 14) ELSE note END AS short,
    CASE WHEN b / 1048576 > 1 THEN printf('%.1fm', b / 1048576) WHEN b / 1024 > 1 THEN printf('%.0fk', b / 1024) ELSE printf('%.0fb', CAST(b AS DOUBLE)) END AS rate,
    CASE WHEN g / 1073741824 >= 1 THEN printf('%.0fG', g / 1073741824) WHEN g / 1048576 >= 1 THEN printf('%.0fM', g / 1048576) ELSE CAST(g AS VARCHAR) END AS size,
    strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM (SELECT *, o_orderpriority || ' ' || o_orderstatus || repeat('-', CAST(o_custkey % 30 AS INTEGER)) AS note, o_orderkey * (o_custkey % 2000) AS b,
          o_orderkey * o_custkey * 997 AS g FROM orders)""")
def report_format(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    note = F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.repeat(F.lit("-"), (cust % 30).cast("int")))
    return table(spark, sf, "orders").select(
        "o_orderkey", report.commas(key * 1000003).alias("commas"), report.ordinal(key).alias("ordinal"),
        report.fill(F.lpad(cust.cast("string"), 10, "0"), "(XXX) XXX-XXXX").alias("phone"),
        report.fill_date(F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("filled_date"), report.base36(key * 7919).alias("base36"),
        report.shorten(note).alias("short"), report.rate_text(key * (cust % 2000)).alias("rate"), report.size_text(key * cust * 997).alias("size"),
        report.date_text(F.col("o_orderdate")).alias("day"))


def age_sql(then, now):
    def said(n, unit):
        return f"abs({n}) || ' {unit}' || CASE WHEN abs({n}) <> 1 THEN 's' ELSE '' END || CASE WHEN {n} < 0 THEN ' from now' ELSE ' ago' END"
    return f"""CASE WHEN abs(days) >= 4 THEN strftime({then}, '%B ') || lpad(CAST(day({then}) AS VARCHAR), 2, ' ')
          || CASE WHEN year({then}) <> year({now}) OR days < 0 THEN ', ' || year({then}) ELSE '' END
        WHEN days <> 0 THEN {said('days', 'day')}
        WHEN abs(s) > 3600 THEN {said("CAST(floor(s / 3600) AS BIGINT)", 'hour')}
        WHEN abs(s) > 60 THEN {said("CAST(floor(s / 60) AS BIGINT)", 'minute')}
        WHEN s <> 0 THEN {said('s', 'second')}
        WHEN abs(us) > 1000 THEN {said("CAST(floor(us / 1000) AS BIGINT)", 'millisecond')} ELSE {said('us', 'microsecond')} END"""


@query("c3_event_age", f"""WITH d AS (SELECT event_id, ts, date_diff('microsecond', ts, TIMESTAMP '2024-01-15 12:00:00') AS us FROM events),
    s AS (SELECT *, us // 1000000 AS s, (us // 1000000) // 86400 AS days FROM d)
    SELECT event_id, {age_sql("ts", "TIMESTAMP '2024-01-15 12:00:00'")} AS age FROM s""")
def event_age(spark, sf):
    return table(spark, sf, "events").select("event_id", report.age(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")).alias("age"))


@query("c3_order_age", f"""WITH d AS (SELECT o_orderkey, o_orderdate, date_diff('microsecond', o_orderdate, TIMESTAMP '1998-08-01 06:30:00') AS us FROM orders),
    s AS (SELECT *, us // 1000000 AS s, (us // 1000000) // 86400 AS days FROM d)
    SELECT o_orderkey, {age_sql("o_orderdate", "TIMESTAMP '1998-08-01 06:30:00'")} AS age FROM s""")
def order_age(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", report.age(F.col("o_orderdate"), F.lit("1998-08-01 06:30:00").cast("timestamp_ntz")).alias("age"))


@query("c4_required_defaults", """SELECT p_partkey, string_split(p_name, ' ')[-1] AS words, array_to_string([p_brand], ',') AS brands, 'none' AS missing,
    CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS bulk FROM part""")
def required_defaults(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.col("p_brand").alias("brands"), "p_size")
    shaped = records.shape(rows, ["p_partkey"], {"brands": ["x"], "missing": "none"})
    return shaped.select("p_partkey", "words", F.array_join("brands", ",").alias("brands"), "missing",
                         records.if_else(F.col("p_size") > 25, "large", "small").alias("bulk"))


PAGE = "(SELECT page_id, '[link](' || url || ') see ' || url || ' in ' || html AS body FROM pages)"


def page_text(spark, sf):
    """The page with its address in front, once as a markdown link and once bare."""
    body = F.concat(F.lit("[link]("), "url", F.lit(") see "), "url", F.lit(" in "), "html")
    return table(spark, sf, "pages").select("page_id", body.alias("body"))


@query("c5_url_inventory", f"""SELECT page_id, unnest(regexp_extract_all(body, '(^|[^(])(http://\\S+)', 2)) AS url FROM {PAGE}""")
def url_inventory(spark, sf):
    return page_text(spark, sf).select("page_id", F.explode(text.urls(F.col("body"))).alias("url"))


@query("c5_escape_markup", f"""SELECT page_id, md5(regexp_replace(replace(body, '<', '&lt;'), '(^|[^(])(http://\\S+)', '\\1<\\2>', 'g')) AS escaped,
    md5(regexp_replace(body, 'class="(\\w+)"', 'class=x', 'g')) AS replaced, regexp_extract_all(body, 'class="(\\w+)"', 1)[-1] AS last_class FROM {PAGE}""")
def escape_markup(spark, sf):
    replaced, last = text.replace_and_last(F.col("body"), r'class="(\w+)"', "class=x")
    return page_text(spark, sf).select("page_id", F.md5(text.escape_markup(F.col("body"))).alias("escaped"),
                                       F.md5(replaced).alias("replaced"), F.get(last, F.lit(0)).alias("last_class"))


@query("c6_json_rows", """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, 'none' AS absent,
    '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","props":{"k":' || (props->>'$.k') || '}}' AS json FROM events""")
def json_rows(spark, sf):
    events = table(spark, sf, "events").select("event_id", "ts", "props")
    absent = records.read_field(F.col("props"), "list[3]", "none")
    parsed = records.parse_json(events.withColumn("absent", absent), "props", "k bigint")
    shown = parsed.select("event_id", "ts", "props")
    return parsed.select("event_id", F.col("props.k").alias("k"), "absent", json_of(shown).alias("json"))


@query("c7_fingerprints", """SELECT c_custkey, md5(c_name || c_nationkey) AS token, 'users_' || md5('users$' || c_custkey || '$' || c_mktsegment) AS cache_key,
    c_mktsegment || '$' || sha1(c_mktsegment || c_name) AS stored, c_custkey % 2 = 0 AS verified FROM customer""")
def fingerprints(spark, sf):
    stored = records.salted(F.col("c_mktsegment"), F.col("c_name"))
    offered = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("?")))
    return table(spark, sf, "customer").select(
        "c_custkey", records.fingerprint(F.col("c_name"), F.col("c_nationkey")).alias("token"),
        records.call_key("users", F.col("c_custkey"), F.col("c_mktsegment")).alias("cache_key"), stored.alias("stored"),
        records.verify(offered, stored).alias("verified"))


STATEMENT = {"click": "SELECT * FROM clicks WHERE id = ", "view": "select a, b from pages where id = ", "purchase": "INSERT INTO sales VALUES ",
             "signup": "UPDATE users SET seen = ", "error": "delete from errors where id = "}


@query("c8_statement_log", """SELECT CASE event_type WHEN 'purchase' THEN 'insert' WHEN 'signup' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'select' END AS kind,
    CASE event_type WHEN 'click' THEN 'clicks' WHEN 'view' THEN 'pages' WHEN 'purchase' THEN 'sales' WHEN 'signup' THEN 'users' ELSE 'errors' END AS "table",
    event_type IN ('click', 'view') AS reads, CASE WHEN event_type IN ('click', 'view') THEN 'read' ELSE 'write' END AS target, count(*) AS n FROM events GROUP BY ALL""")
def statement_log(spark, sf):
    head = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATEMENT.items()])
    log = table(spark, sf, "events").select(F.concat(head, F.col("event_id")).alias("sql"))
    return text.classify_statements(log, "sql").groupBy("kind", "table", "reads", "target").agg(F.count(F.lit(1)).alias("n"))


def hex_of(c, width):
    return F.lpad(F.hex(c), width, "0")


def frames(spark, sf):
    """Ethernet frames with IPv4 headers made from events."""
    e, u = F.col("event_id"), F.col("user_id")
    parts = [hex_of(u + 1, 12), hex_of(u, 12), F.lit("0800"), F.lit("4500"), hex_of(e % 1500 + 20, 4), hex_of(e % 65536, 4), F.lit("4000"),
             F.lit("40"), hex_of(e % 2 * 11 + 6, 2), F.lit("ABCD"), F.lit("0A00"), hex_of(u % 65536, 4), F.lit("0A01"), hex_of(u % 7, 4)]
    return table(spark, sf, "events").select("event_id", F.unhex(F.concat(*parts)).alias("frame"))


@query("c9_frame_headers", """SELECT event_id, lower(lpad(hex(user_id + 1), 12, '0')) AS eth_dst, lower(lpad(hex(user_id), 12, '0')) AS eth_src, 2048::BIGINT AS eth_type,
    69::BIGINT AS version_ihl, 0::BIGINT AS tos, event_id % 1500 + 20 AS length, event_id % 65536 AS ident, 16384::BIGINT AS flags_offset, 64::BIGINT AS ttl,
    event_id % 2 * 11 + 6 AS protocol, 43981::BIGINT AS checksum, 167772160 + user_id % 65536 AS ip_src, 167837696 + user_id % 7 AS ip_dst FROM events""")
def frame_headers(spark, sf):
    f = F.col("frame")
    return frames(spark, sf).select("event_id", *[c.alias(n) for n, c in (records.ethernet(f) | records.ipv4(f)).items()])


@query("c9_traffic", """SELECT 167772160 + user_id % 65536 AS ip_src, 167837696 + user_id % 7 AS ip_dst, event_id % 2 * 11 + 6 AS protocol, count(*) AS frames,
    CAST(sum(event_id % 1500 + 20) AS BIGINT) AS bytes FROM events GROUP BY 1, 2, 3""")
def frame_traffic(spark, sf):
    return records.traffic(frames(spark, sf), "frame")


# --- user functions ------------------------------------------------------------------------------

@query("f1_user_function", "SELECT c_custkey, upper(c_name) AS c_name, c_acctbal * 2 AS doubled FROM customer")
def user_function(spark, sf):
    def hook(df):
        return df.withColumn("doubled", F.col("c_acctbal") * 2).drop("c_acctbal")
    return user.prepare(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), hook, c_name=F.upper)


@query("f2_bulk_action", """SELECT o_orderkey, 'closed' AS o_orderstatus FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def bulk_action(spark, sf):
    actions = user.Actions()
    actions.add("close", lambda df: df.select("o_orderkey", F.lit("closed").alias("o_orderstatus")))
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return actions.run("close", table(spark, sf, "orders"), "o_orderkey", ids)


def risky(row):
    if row["event_type"] == "error":
        raise ValueError(f"event {row['event_id']}")
    return float(row["event_id"] * 2)


@query("f3_safe_map", """SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(event_id * 2 AS DOUBLE) END AS value, event_type <> 'error' AS ok,
    CASE WHEN event_type = 'error' THEN 'ValueError: event ' || event_id END AS error FROM events""")
def safe(spark, sf):
    return user.safe_map(table(spark, sf, "events").select("event_id", "event_type"), risky, "double", keep=["event_id"])


@query("f3_skip_failures", "SELECT event_id, CAST(event_id * 2 AS DOUBLE) AS value FROM events WHERE event_type <> 'error'")
def skipping(spark, sf):
    done = user.safe_map(table(spark, sf, "events").select("event_id", "event_type"), risky, "double", True, ["event_id"])
    return done.select("event_id", "value")


@query("f3_exact_keys", """SELECT event_id + 1152921504606846977 AS id, CASE WHEN user_id % 5 <> 0 THEN user_id % 5 END AS part,
    CASE WHEN user_id % 5 <> 0 THEN event_id + 1152921504606846977 + user_id % 5 END AS value, user_id % 5 <> 0 AS ok FROM events""")
def exact_keys(spark, sf):
    """Whole numbers beyond 2^53 and nulls reach the function and come back as they are; text doesn't fit and fails its row."""
    rows = table(spark, sf, "events").select((F.col("event_id") + F.lit(2**60 + 1)).alias("id"), F.nullif(F.col("user_id") % 5, F.lit(0)).alias("part"))
    return user.safe_map(rows, lambda r: "none" if r["part"] is None else r["id"] + r["part"], "bigint").drop("error")
