"""Sources, sinks, shards and log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.base import Shop, query, table
from opsframe.operators.aggregates import hosts_by_path
from opsframe.plans.model import Model
from opsframe.plans.session import scratch
from opsframe.sources import documents, inventory, logs, writes
from opsframe.sources.shards import ShardMap, delete_shard_rows, read_shard, replace_shard, update_shard_rows, write_sharded
from opsframe.sources.tables import scan


@query("s1_table_scan", "SELECT * FROM orders")
def table_scan(spark, sf):
    return scan(spark, f"{sf}/orders.parquet")


@query("s1_text_scan", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def text_scan(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = writes.publish(rows, "customer-csv", "csv")
    return scan(spark, path, "csv", schema=rows.schema)


def message_lines(spark, sf):
    """Events as log lines in one folder per event type."""
    path = scratch(spark, "log-lines")
    lines = table(spark, sf, "events").select("event_type", F.concat_ws(" ", "event_id", "user_id", "props").alias("value"))
    lines.write.partitionBy("event_type").text(path)
    return path


TAILS = [logs.TailRule("/event_type=error/", "app-error", "error"), logs.TailRule("/event_type=purchase/", "shop", "notice", "local5"),
         logs.TailRule("/event_type=(click|view)/", "web", "info"), logs.TailRule("/event_type=signup/", "accounts", "warning", "authpriv")]
TAGGED = """tagged AS (SELECT event_id, CAST(event_id AS VARCHAR) || ' ' || user_id || ' ' || props AS msg,
    CASE event_type WHEN 'error' THEN 'app-error' WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'accounts' ELSE 'web' END AS tag,
    CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 ELSE 6 END AS severity,
    CASE event_type WHEN 'purchase' THEN 21 WHEN 'signup' THEN 10 ELSE 22 END AS facility FROM events)"""


@query("s3_tagged_lines", f"WITH {TAGGED} SELECT msg, tag, severity, facility FROM tagged")
def tagged_lines(spark, sf):
    return logs.read_lines(spark, message_lines(spark, sf), TAILS).drop("file")


@query("s4_forward", f"WITH {TAGGED} SELECT 'ops' AS topic, tag AS key, msg AS value FROM tagged")
def forward(spark, sf):
    path = scratch(spark, "forward")
    logs.forward(logs.read_lines(spark, message_lines(spark, sf), TAILS), "ops", sink="json", key="tag", path=path)
    return spark.read.schema("topic string, key string, value string").json(path)


MESSAGES = """m AS (SELECT event_id, event_id % 24 AS facility, (event_id // 24) % 8 AS severity FROM events)"""
ROUTES = {"messages": "*.info;mail.none;authpriv.none;cron.none", "secure": "authpriv.*", "cron": "cron.*", "kern": "kern.*",
          "daemon": "daemon.*", "syslog": "syslog.*", "remote": "local6.*", "urgent": "kern,daemon.err;local7.crit"}
ROUTE_SQL = {"messages": "severity <= 6 AND facility NOT IN (2, 10, 9)", "secure": "facility = 10", "cron": "facility = 9", "kern": "facility = 0",
             "daemon": "facility = 3", "syslog": "facility = 5", "remote": "facility = 22",
             "urgent": "(facility IN (0, 3) AND severity <= 3) OR (facility = 23 AND severity <= 2)"}


def messages(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "props", (e % 24).alias("facility"),
                                             (F.floor(e / 24) % 8).alias("severity"))


@query("s5_severity_routing", f"WITH {MESSAGES} " + " UNION ALL ".join(
    f"SELECT event_id, facility, severity, '{r}' AS route FROM m WHERE {w}" for r, w in ROUTE_SQL.items()))
def routing(spark, sf):
    return logs.route(messages(spark, sf).select("event_id", "facility", "severity"), ROUTES)


@query("s6_line_format", f"""WITH m AS (SELECT *, event_id % 24 AS facility, (event_id // 24) % 8 AS severity FROM events),
    x AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN ' ' || props ELSE props END AS msg FROM m)
    SELECT event_id, '<' || (facility * 8 + severity) || '>' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' host' || user_id || ' ops - - ' || event_type
    || CASE WHEN msg LIKE ' %' THEN '' ELSE ' ' END || msg AS line, '10.0.0.1 ' || event_type || ' ' || msg AS plain FROM x""")
def line_format(spark, sf):
    msg = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "props")).otherwise(F.col("props"))
    line = logs.format_line(logs.priority(F.col("facility"), F.col("severity")), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                            F.concat(F.lit("host"), "user_id"), F.lit("ops"), F.lit("-"), F.lit("-"), F.col("event_type"), msg)
    return messages(spark, sf).select("event_id", line.alias("line"), logs.plain_line(F.lit("10.0.0.1"), F.col("event_type"), msg).alias("plain"))


@query("s7_json_export", """WITH o AS (SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
    || '","customer__c_name":"' || c_name || '","customer__nation__n_name":"' || n_name || '"}' AS j, o_orderkey = min(o_orderkey) OVER () AS head
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT 1 AS rank, CASE WHEN head THEN '' ELSE ',' END || j AS line FROM o UNION ALL SELECT 0, '[' UNION ALL SELECT 2, ']'""")
def json_export(spark, sf):
    return inventory.export_json(Shop(spark, sf).orders, ["o_orderkey", "o_orderdate", "customer__c_name", "customer__nation__n_name"], ["o_orderkey"])


@query("s7_json_array", """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","c_name":"' || c_name || '"}' AS object
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def json_array(spark, sf):
    """The elements of one array that many tasks wrote under one commit."""
    path = scratch(spark, "array")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderdate", "c_name")
    documents.write_document(rows.orderBy("o_orderkey").select(inventory.json_of(rows)), path, documents.JsonArray)
    return spark.read.text(path).where("value NOT IN ('[', ',', ']', '')").select(F.regexp_replace("value", ",$", "").alias("object"))


def customer_copy(spark, sf):
    return writes.publish(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey"), "customer")


NEW_IDS = "(SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey)"


@query("s8_append_rows", f"""SELECT c_custkey, c_name, c_nationkey FROM customer
    UNION ALL SELECT {NEW_IDS}, s_name, NULL FROM supplier""")
def append_rows(spark, sf):
    path = customer_copy(spark, sf)
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("c_name"), "s_suppkey")
    target = spark.read.parquet(path)
    writes.append(writes.with_ids(rows, target, "c_custkey", ["s_suppkey"]).drop("s_suppkey"), path)
    return spark.read.parquet(path)


@query("s9_sequence_ids", f"SELECT {NEW_IDS} AS c_custkey, s_suppkey FROM supplier")
def sequence_ids(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey")
    return writes.with_ids(rows, table(spark, sf, "customer"), "c_custkey", ["s_suppkey"])


@query("s10_insert_or_ignore", """WITH n AS (SELECT o_custkey * 2 AS c_custkey, min_by(o_orderpriority, o_orderkey) AS c_name FROM orders GROUP BY 1)
    SELECT c_custkey, c_name, c_nationkey FROM customer UNION ALL
    SELECT c_custkey, c_name, NULL FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def insert_or_ignore(spark, sf):
    path = customer_copy(spark, sf)
    rows = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey"), F.col("o_orderpriority").alias("c_name"), "o_orderkey")
    writes.insert_or_ignore(rows, path, ["c_custkey"], ["o_orderkey"])
    return spark.read.parquet(path)


@query("s11_update_where", """SELECT c_custkey, CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN upper(c_name) ELSE c_name END AS c_name,
    CASE WHEN c_acctbal < 0 OR c_mktsegment = 'BUILDING' THEN 0 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def update_rows(spark, sf):
    changed = writes.update_where(table(spark, sf, "customer"), (F.col("c_acctbal") < 0) | (F.col("c_mktsegment") == "BUILDING"),
                                  {"c_name": F.upper("c_name"), "c_nationkey": F.lit(0)})
    return spark.read.parquet(writes.publish(changed, "customer-updated"))


@query("s11_update_count", "SELECT count(*) FILTER (c_acctbal < 1000) AS matched, count(*) AS rows FROM customer")
def update_count(spark, sf):
    return writes.change_counts(table(spark, sf, "customer"), F.col("c_acctbal") < 1000)


@query("s12_delete_where", """SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 200000)
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def delete_rows(spark, sf):
    orders = writes.delete_where(table(spark, sf, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 200000))
    rich = table(spark, sf, "customer").filter("c_acctbal > 9000").select("c_custkey")
    return writes.delete_where(orders, F.col("o_custkey") == F.col("c_custkey"), using=rich)


def family(spark, sf):
    """region <- nation <- customer <- orders (required), nation <- supplier (nullable)."""
    region = Model("region", table(spark, sf, "region"), "r_regionkey")
    nation = Model("nation", table(spark, sf, "nation"), "n_nationkey").link("region", "n_regionkey", region)
    customer = Model("customer", table(spark, sf, "customer"), "c_custkey").link("nation", "c_nationkey", nation)
    supplier = Model("supplier", table(spark, sf, "supplier"), "s_suppkey").link("nation", "s_nationkey", nation, nullable=True)
    orders = Model("orders", table(spark, sf, "orders"), "o_orderkey").link("customer", "o_custkey", customer)
    return [region, nation, customer, supplier, orders]


GONE = """n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')),
    c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))"""


@query("s13_dependency_preview", f"""WITH {GONE} SELECT 'nation' AS model, CAST(n_nationkey AS BIGINT) AS id FROM n
    UNION ALL SELECT 'customer', c_custkey FROM c UNION ALL SELECT 'orders', o_orderkey FROM o""")
def preview(spark, sf):
    models = family(spark, sf)
    gone = models[0].frame.filter(F.col("r_name").isin("ASIA", "EUROPE")).select("r_regionkey")
    return writes.dependency_preview(models, models[0], gone)


@query("s13_cascade_delete", f"""WITH {GONE} SELECT 'region' AS model, CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS ref FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')
    UNION ALL SELECT 'nation', n_nationkey, n_regionkey FROM nation WHERE n_nationkey NOT IN (FROM n)
    UNION ALL SELECT 'customer', c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (FROM c)
    UNION ALL SELECT 'supplier', s_suppkey, CASE WHEN s_nationkey NOT IN (FROM n) THEN s_nationkey END FROM supplier
    UNION ALL SELECT 'orders', o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (FROM o)""")
def cascade(spark, sf):
    models = family(spark, sf)
    gone = models[0].frame.filter(F.col("r_name").isin("ASIA", "EUROPE")).select("r_regionkey")
    left, out = writes.cascade_delete(models, models[0], gone), None
    for m in models:
        ref = F.col(next(iter(m.links.values())).column).cast("long") if m.links else F.lit(None).cast("long")
        part = left[m.name].select(F.lit(m.name).alias("model"), F.col(m.key).cast("long").alias("id"), ref.alias("ref"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s14_daily_files", "SELECT event_id, strftime(ts, '%Y%m%d') AS day FROM events")
def daily(spark, sf):
    path = scratch(spark, "daily")
    writes.write_daily(table(spark, sf, "events").select("event_id", "ts"), path, "ts")
    return spark.read.schema("event_id bigint, ts timestamp_ntz, day string").parquet(path).select("event_id", "day")


@query("s15_inventory", """WITH h AS (SELECT DISTINCT r_name || '->' || n_name || '->' || c_mktsegment AS g, c_name FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT '[' || g || ']' AS line FROM (SELECT DISTINCT g FROM h) UNION ALL SELECT c_name FROM h UNION ALL SELECT '' FROM (SELECT DISTINCT g FROM h)""")
def inventory_file(spark, sf):
    from opsframe.catalog.selection import assets
    path = scratch(spark, "inventory")
    inventory.write_inventory(hosts_by_path(assets(spark, sf), ["r_name", "n_name", "c_mktsegment"], "c_name"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("s15_inventory_document", """WITH h AS (SELECT DISTINCT r_name || '->' || n_name || '->' || c_mktsegment AS g, c_name FROM customer
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT '[' || g || ']' AS line FROM (SELECT DISTINCT g FROM h) UNION ALL SELECT c_name FROM h""")
def inventory_document(spark, sf):
    from opsframe.catalog.selection import assets
    path = scratch(spark, "inventory")
    groups = hosts_by_path(assets(spark, sf), ["r_name", "n_name", "c_mktsegment"], "c_name")
    documents.write_document(inventory.inventory_lines(groups).select("line"), path, documents.OneText)
    return spark.read.text(path).where("value <> ''").withColumnRenamed("value", "line")


ROWS_PER_TASK = 100_000


def spread(rows):
    """Rows over tasks of ROWS_PER_TASK: one file may hold millions of keys, each of which becomes a long line of facts."""
    return rows.repartition(1 + rows.count() // ROWS_PER_TASK)


@query("s16_host_facts", """SELECT md5(CAST(c_custkey // 2 AS VARCHAR)) AS product_uuid, min_by(c_name, c_custkey) AS hostname, min_by(c_mktsegment, c_custkey) AS distribution,
    CAST(min_by(c_custkey % 8, c_custkey) AS INTEGER) AS processor_cores, min_by('{"address":"10.0.0.' || (c_custkey % 250) || '"}', c_custkey) AS ipv4,
    CAST(NULL AS VARCHAR) AS domain, TIMESTAMP '2024-02-01' AS last_update FROM customer GROUP BY c_custkey // 2""")
def host_facts(spark, sf):
    key = F.col("c_custkey")
    facts = F.create_map(F.lit("ansible_hostname"), F.col("c_name"), F.lit("ansible_distribution"), F.col("c_mktsegment"))
    numbers = F.format_string(',"ansible_processor_cores":%d,"ansible_default_ipv4":{"address":"10.0.0.%d"},"ansible_product_uuid":"%s"}}',
                              key % 8, key % 250, F.md5(F.floor(key / 2).cast("string")))
    text = F.concat(F.col("c_name"), F.lit(' | success => {"ansible_facts":'), F.regexp_replace(F.to_json(facts), "}$", ""), numbers)
    lines = spread(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")).select("c_custkey", text.alias("text"))
    rows = inventory.read_facts(lines, "text", F.lit("2024-02-01").cast("timestamp_ntz"))
    path = scratch(spark, "facts")
    rows.limit(0).drop("c_custkey", "text").write.parquet(path)
    writes.insert_or_ignore(rows.drop("text"), path, ["product_uuid"], ["c_custkey"])
    return spark.read.schema(rows.drop("c_custkey", "text").schema).parquet(path).select(
        "product_uuid", "hostname", "distribution", "processor_cores", "ipv4", "domain", "last_update")


# every stored fact: what `setup` reports for it, and the text that is stored
HARDWARE = {n: f"'{n}-' || (c_custkey % {i + 3})" for i, n in enumerate(inventory.FACTS)} | {
    n: f"CAST(c_custkey % {i} AS INTEGER)" for i, n in enumerate(inventory.NUMBERS, 5)} | {
    n: f"""'{{"address":"' || (c_custkey % 250) || '"}}'""" for n in ("ipv4", "ipv6", "eth0", "eth1")} | {
    "product_uuid": "md5(CAST(c_custkey // 2 AS VARCHAR))", "mounts": """'[{"mount":"/data' || (c_custkey % 3) || '"}]'"""}


@query("s16_all_host_facts", "SELECT " + ", ".join(
    f"{x if n == 'product_uuid' else f'min_by({x}, c_custkey)'} AS {n}" for n, x in HARDWARE.items()) + """,
    TIMESTAMP '2024-02-01' AS last_update FROM customer GROUP BY c_custkey // 2""")
def all_host_facts(spark, sf):
    key = F.col("c_custkey")
    found = {n: F.concat(F.lit(f"{n}-"), key % (i + 3)) for i, n in enumerate(inventory.FACTS)}
    found |= {n: key % i for i, n in enumerate(inventory.NUMBERS, 5)}
    found |= {n: F.struct((key % 250).cast("string").alias("address")) for n in ("ipv4", "ipv6", "eth0", "eth1")}
    found |= {"product_uuid": F.md5(F.floor(key / 2).cast("string")),
              "mounts": F.array(F.struct(F.concat(F.lit("/data"), key % 3).alias("mount")))}
    facts = F.struct(*[x.alias(f"ansible_{inventory.FACT_KEYS.get(n, n)}") for n, x in found.items()])
    text = F.concat(F.col("c_name"), F.lit(" | success => "), F.to_json(F.struct(facts.alias("ansible_facts"))))
    lines = spread(table(spark, sf, "customer").select("c_custkey", "c_name")).select("c_custkey", text.alias("text"))
    rows = inventory.read_facts(lines, "text", F.lit("2024-02-01").cast("timestamp_ntz"))
    path = scratch(spark, "facts")
    rows.limit(0).drop("c_custkey", "text").write.parquet(path)
    writes.insert_or_ignore(rows.drop("text"), path, ["product_uuid"], ["c_custkey"])
    return spark.read.schema(rows.drop("c_custkey", "text").schema).parquet(path).select(*inventory.FACTS, "last_update")


# --- shards --------------------------------------------------------------------------------------

TEN = ShardMap((("node_a", 0, 3), ("node_b", 4, 6), ("node_c", 7, 9)))
THOUSAND = ShardMap((("main", 0, 999),))


@query("h1_shard_node", """SELECT o_orderkey, o_custkey % 10 AS hash, CASE WHEN o_custkey % 10 <= 3 THEN 'node_a' WHEN o_custkey % 10 <= 6 THEN 'node_b'
    ELSE 'node_c' END AS node FROM orders""")
def shard_node(spark, sf):
    key = F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", TEN.hash(key).alias("hash"), TEN.require_node(key).alias("node"))


@query("h2_shard_table", """SELECT o_orderkey, 'orders_' || lpad(CAST(o_custkey % 10 AS VARCHAR), 2, '0') AS small,
    'comment_' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 4, '0') AS large FROM orders""")
def shard_table(spark, sf):
    key = F.col("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", TEN.table("orders", key).alias("small"), THOUSAND.table("comment", key).alias("large"))


@query("h3_shard_read", "SELECT * FROM orders WHERE o_custkey = 77")
def shard_read(spark, sf):
    path = scratch(spark, "sharded")
    write_sharded(table(spark, sf, "orders"), TEN, "o_custkey", path)
    return read_shard(spark, TEN, "o_custkey", 77, path)


@query("h3_shard_delete", "SELECT * FROM orders WHERE o_custkey % 10 = 7 AND NOT (o_custkey = 77 AND o_orderstatus = 'F')")
def shard_delete(spark, sf):
    path = scratch(spark, "sharded")
    write_sharded(table(spark, sf, "orders"), TEN, "o_custkey", path)
    return delete_shard_rows(spark, TEN, "o_custkey", 77, path, F.col("o_orderstatus") == "F").drop("_shard")


@query("h3_shard_update", """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 77 AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
    FROM orders WHERE o_custkey % 10 = 7""")
def shard_update(spark, sf):
    path = scratch(spark, "sharded")
    write_sharded(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), TEN, "o_custkey", path)
    rows = update_shard_rows(spark, TEN, "o_custkey", 77, path, F.col("o_totalprice") > 100000, {"o_orderstatus": F.lit("X")})
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("h3_shard_delete_table", "SELECT * FROM orders WHERE NOT (o_custkey = 77 AND o_orderstatus = 'F')")
def shard_delete_table(spark, sf):
    path, orders = scratch(spark, "sharded"), table(spark, sf, "orders")
    write_sharded(orders, TEN, "o_custkey", path)
    replace_shard(delete_shard_rows(spark, TEN, "o_custkey", 77, path, F.col("o_orderstatus") == "F"), TEN, 77, path)
    return spark.read.parquet(path).select(*orders.columns)


@query("h3_shard_update_table", """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey = 77 AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""")
def shard_update_table(spark, sf):
    path = scratch(spark, "sharded")
    write_sharded(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), TEN, "o_custkey", path)
    replace_shard(update_shard_rows(spark, TEN, "o_custkey", 77, path, F.col("o_totalprice") > 100000, {"o_orderstatus": F.lit("X")}), TEN, 77, path)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus")
