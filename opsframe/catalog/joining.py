"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.base import Shop, query, table
from opsframe.operators import joins
from opsframe.plans.model import select_lookups


@query("j1_comma_join", """SELECT o_orderkey, c_name FROM orders, customer
    WHERE o_custkey = c_custkey AND o_totalprice > 10 * c_acctbal""")
def comma(spark, sf):
    joined = joins.comma_join(table(spark, sf, "orders"), table(spark, sf, "customer"),
                              (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 10 * F.col("c_acctbal")))
    return joined.select("o_orderkey", "c_name")


@query("j2_fk_path_join", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, cn.n_name AS customer_nation, sn.n_name AS supplier_nation,
    r_name AS region, p_brand AS brand
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN region ON cn.n_regionkey = r_regionkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey JOIN part ON l_partkey = p_partkey""")
def fk_path(spark, sf):
    names = {"order__customer__nation__n_name": "customer_nation", "supplier__nation__n_name": "supplier_nation",
             "order__customer__nation__region__r_name": "region", "part__p_brand": "brand"}
    own = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return select_lookups(Shop(spark, sf).lineitem, own + list(names)).withColumnsRenamed(names)


@query("j3_nested_embed", """SELECT o_orderkey, c_custkey AS customer, c_name AS name, n_nationkey AS nation, n_name, r_name
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey""")
def embed(spark, sf):
    nested = joins.embed(Shop(spark, sf).orders, ["customer__nation__region"])
    c = "o_custkey"
    n = f"{c}.c_nationkey"
    return nested.select("o_orderkey", F.col(f"{c}.c_custkey").alias("customer"), F.col(f"{c}.c_name").alias("name"),
                         F.col(f"{n}.n_nationkey").alias("nation"), F.col(f"{n}.n_name").alias("n_name"),
                         F.col(f"{n}.n_regionkey.r_name").alias("r_name"))


@query("j4_split_nested", """SELECT 'parent' AS part, CAST(o_orderkey AS BIGINT) AS id, CAST(o_custkey AS BIGINT) AS ref, '' AS name FROM orders
    UNION ALL SELECT DISTINCT 'related', c_custkey, CAST(c_nationkey AS BIGINT), c_name FROM customer JOIN orders ON o_custkey = c_custkey""")
def split(spark, sf):
    parents, related = joins.split_nested(joins.embed(Shop(spark, sf).orders, ["customer"]), "o_custkey", "c_custkey")
    top = parents.select(F.lit("parent").alias("part"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ref"),
                         F.lit("").alias("name"))
    return top.unionByName(related.select(F.lit("related").alias("part"), F.col("c_custkey").alias("id"),
                                          F.col("c_nationkey").cast("long").alias("ref"), F.col("c_name").alias("name")))


@query("j5_chosen_ids", "SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def chosen(spark, sf):
    ids = table(spark, sf, "customer").filter("c_acctbal > 5000").select("c_custkey")
    return joins.chosen(table(spark, sf, "orders"), ids, "o_custkey")


@query("j6_related_choices", """SELECT 0 AS rank, '__None' AS id, 'None' AS repr UNION ALL SELECT * FROM (
    SELECT 1, CAST(c_custkey AS VARCHAR), c_name FROM customer WHERE c_name ILIKE '%#00000%' ORDER BY c_name, c_custkey LIMIT 15 OFFSET 15)""")
def choices(spark, sf):
    return joins.related_choices(table(spark, sf, "customer"), "c_custkey", "c_name", True, "#00000", 2)


CHOSEN = "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%#00000%'"


@query("j6_choices_page", f"""WITH c AS ({CHOSEN}), n AS (SELECT 2 - 1 AS prev_page, CASE WHEN ceil(count(*) / 15.0) > 2 THEN 3 ELSE 0 END AS next_page FROM c)
    SELECT r.*, CAST(prev_page AS BIGINT) AS prev_page, CAST(next_page AS BIGINT) AS next_page FROM n, (SELECT 0 AS rank, '__None' AS id, 'None' AS repr UNION ALL SELECT * FROM (
    SELECT 1, CAST(c_custkey AS VARCHAR), c_name FROM c ORDER BY c_name, c_custkey LIMIT 15 OFFSET 15)) r""")
def choices_page(spark, sf):
    customer = table(spark, sf, "customer")
    around = joins.choices_around(customer, "c_name", "#00000", 2)
    return joins.related_choices(customer, "c_custkey", "c_name", True, "#00000", 2).join(F.broadcast(around))


TOPOLOGY = """switch AS (SELECT 'sw' || n_nationkey AS dpid FROM nation),
    port AS (SELECT 'sw' || s_nationkey AS dpid, 'sw' || s_nationkey || '/' || s_suppkey AS port_id, s_suppkey AS number,
             'eth' || s_suppkey AS "desc" FROM supplier),
    host AS (SELECT 'eth' || (c_custkey % (SELECT count(*) FROM supplier)) AS "desc", c_name AS dl_addr FROM customer)"""


def topology(spark, sf):
    """Switch = nation, port = supplier, device = customer plugged into one of the suppliers' ports."""
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    switches = nation.select(F.concat(F.lit("sw"), "n_nationkey").alias("dpid"))
    dpid = F.concat(F.lit("sw"), "s_nationkey")
    ports = supplier.select(dpid.alias("dpid"), F.concat(dpid, F.lit("/"), "s_suppkey").alias("port_id"),
                            F.col("s_suppkey").alias("number"), F.concat(F.lit("eth"), "s_suppkey").alias("desc"))
    n = supplier.agg(F.count(F.lit(1)).alias("n"))
    hosts = table(spark, sf, "customer").join(F.broadcast(n)).select(
        F.concat(F.lit("eth"), F.col("c_custkey") % F.col("n")).alias("desc"), F.col("c_name").alias("dl_addr"))
    return switches, ports, hosts


def port_links(spark, sf):
    """A link from each port to the port of the next supplier key, where there is one."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("sw"), "s_nationkey").alias("dpid"))
    other = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("dpid").alias("dst_dpid"))
    return s.join(other, "s_suppkey").select(F.col("dpid").alias("src_dpid"), F.col("s_suppkey").alias("src_port"),
                                             "dst_dpid", (F.col("s_suppkey") + 1).alias("dst_port"))


LINKS = """link AS (SELECT a.dpid AS src_dpid, a.number AS src_port, b.dpid AS dst_dpid, b.number AS dst_port,
    a.port_id AS src, b.port_id AS dst FROM port a JOIN port b ON b.number = a.number + 1)"""


@query("j7_topology_joins", f"""WITH {TOPOLOGY}, {LINKS}
    SELECT p.dpid AS src, port_id AS dst, 'out' AS label FROM port p JOIN switch s ON s.dpid = p.dpid
    UNION ALL SELECT port_id, dl_addr, 'out' FROM port JOIN host ON host."desc" = port."desc"
    UNION ALL SELECT src, dst, 'link' FROM link""")
def topology_edges(spark, sf):
    switches, ports, hosts = topology(spark, sf)
    return joins.switch_ports(switches, ports).unionByName(joins.port_devices(ports, hosts)).unionByName(
        joins.link_ports(ports, port_links(spark, sf)))


@query("j8_connected", f"""WITH {TOPOLOGY}, {LINKS}, pair AS (SELECT x.port_id AS a, y.port_id AS b FROM port x
      JOIN port y ON y.number IN (x.number - 1, x.number + 2))
    SELECT DISTINCT a, b FROM pair WHERE EXISTS (SELECT 1 FROM link WHERE (src = a AND dst = b) OR (src = b AND dst = a))""")
def connected(spark, sf):
    _, ports, _ = topology(spark, sf)
    x = ports.select(F.col("port_id").alias("a"), F.explode(F.array(F.col("number") - 1, F.col("number") + 2)).alias("number"))
    pairs = x.join(ports.select("number", F.col("port_id").alias("b")), "number").select("a", "b")
    return joins.connected(pairs, joins.link_ports(ports, port_links(spark, sf)))


@query("j9_subnet_join", """WITH a AS (SELECT event_id, (event_id >> 8) & 255 AS b2, event_id & 255 AS b3, user_id & 255 AS b4 FROM events),
    ip AS (SELECT event_id, '10.' || b2 || '.' || b3 || '.' || b4 AS ip, (10 * 256 + b2) * 65536 + b3 * 256 + b4 AS n,
           b2, b3 FROM a),
    k AS (SELECT n_nationkey AS k FROM nation)
    SELECT event_id, ip, n AS number, CASE WHEN b3 % 2 = 0 THEN '10.' || b2 || '.' || b3 || '.0' WHEN x.k IS NOT NULL THEN '10.' || b2 || '.0.0' END AS segment_ip,
    CASE WHEN b3 % 2 = 0 THEN '255.255.255.0' WHEN x.k IS NOT NULL THEN '255.255.0.0' END AS mask
    FROM ip LEFT JOIN k x ON x.k = b2""")
def subnets(spark, sf):
    e = F.col("event_id")
    octets = [F.lit(10), F.shiftright(e, 8).bitwiseAND(F.lit(255)), e.bitwiseAND(F.lit(255)), F.col("user_id").bitwiseAND(F.lit(255))]
    addresses = table(spark, sf, "events").select("event_id", F.concat_ws(".", *octets).alias("ip"))
    nation = table(spark, sf, "nation")
    wide = nation.select(F.concat(F.lit("10."), "n_nationkey", F.lit(".0.0")).alias("segment_ip"), F.lit("255.255.0.0").alias("mask"))
    # every second /24 in use
    narrow = table(spark, sf, "events").where(octets[2] % 2 == 0).select(
        F.concat_ws(".", *octets[:3], F.lit("0")).alias("segment_ip"), F.lit("255.255.255.0").alias("mask")).distinct()
    found = joins.segment_of(addresses, "ip", wide.unionByName(narrow), "segment_ip", "mask")
    return found.withColumn("number", joins.ip_to_int(F.col("ip")))


def packets(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("ts", "event_id", (F.col("user_id") % 8).alias("switch"), F.col("user_id").alias("src"),
                                             (F.col("user_id") + e % 5).alias("dst"), (e % 16).alias("in_port"))


@query("j10_learned_port", """WITH p AS (SELECT event_id, ts, user_id % 8 AS sw, user_id AS src, user_id + event_id % 5 AS dst, event_id % 16 AS port FROM events),
    u AS (SELECT sw, src AS mac, ts, event_id, 0 AS ask, port FROM p UNION ALL SELECT sw, dst, ts, event_id, 1, NULL FROM p)
    SELECT event_id, sw AS switch, mac AS dst, coalesce(CAST(out_port AS VARCHAR), 'FLOOD') AS out_port FROM (
      SELECT *, last_value(port IGNORE NULLS) OVER (PARTITION BY sw, mac ORDER BY ts, event_id, ask ROWS UNBOUNDED PRECEDING) AS out_port FROM u)
    WHERE ask = 1""")
def learned(spark, sf):
    return joins.learned_port(packets(spark, sf), order=["ts", "event_id"]).select("event_id", "switch", "dst", "out_port")


@query("j11_snapshot_diff", """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
    b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.n AS old_n, b.n AS new_n,
    CASE WHEN a.n IS NULL THEN 'add' WHEN b.n IS NULL THEN 'delete' ELSE 'move' END AS change
    FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.n IS DISTINCT FROM b.n""")
def diff(spark, sf):
    events, key = table(spark, sf, "events"), ["user_id", "event_type"]
    def count(where):
        return events.filter(where).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return joins.snapshot_diff(count("ts < timestamp_ntz'2024-01-16'"), count("ts >= timestamp_ntz'2024-01-16'"), key, ["n"])


@query("j11_states_diff", """WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
    b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '9999-01-01' GROUP BY 1, 2)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, a.n AS old_n, b.n AS new_n,
    CASE WHEN a.n IS NULL THEN 'add' WHEN b.n IS NULL THEN 'delete' ELSE 'move' END AS change
    FROM a FULL JOIN b ON a.user_id IS NOT DISTINCT FROM b.user_id AND a.event_type IS NOT DISTINCT FROM b.event_type WHERE a.n IS DISTINCT FROM b.n""")
def states_diff(spark, sf):
    """The state of all events up to one moment against that up to another, behind the last event."""
    events, key = table(spark, sf, "events"), ["user_id", "event_type"]
    def state(until):
        return events.filter(f"ts < timestamp_ntz'{until}'").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return joins.snapshot_diff(state("2024-01-16"), state("9999-01-01"), key, ["n"])
