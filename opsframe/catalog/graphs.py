"""Graph queries. Small graph: nations; larger graph: users."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsframe.catalog.base import Shop, query, table
from opsframe.catalog.joining import LINKS, TOPOLOGY, port_links, topology
from opsframe.operators import graph as G
from opsframe.plans.model import join_path_columns
from opsframe.plans.ordered import Timeline


def nation_edges(spark, sf):
    """Supplier nation -> customer nation, weight 1 + (lineitems between them) % 9."""
    rows = join_path_columns(Shop(spark, sf).lineitem, ["supplier__s_nationkey", "order__customer__c_nationkey"])
    pairs = rows.groupBy(F.col("supplier__s_nationkey").cast("long").alias("src"), F.col("order__customer__c_nationkey").cast("long").alias("dst"))
    return pairs.agg((1 + F.count(F.lit(1)) % 9).alias("weight")).filter("src <> dst")


NATIONS = """e AS (SELECT * FROM (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, 1 + count(*) % 9 AS weight FROM lineitem
      JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE src <> dst),
    r(source, node, dist) AS (SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT) FROM nation
      UNION SELECT r.source, e.dst, r.dist + e.weight FROM r JOIN e ON r.node = e.src WHERE r.dist + e.weight <= (SELECT 9 * count(*) FROM nation)),
    d AS (SELECT source, node, min(dist) AS dist FROM r GROUP BY 1, 2),
    p AS (SELECT a.source, e.dst AS node, e.src AS pred, a.dist AS pd FROM d a JOIN e ON a.node = e.src
          JOIN d b ON b.source = a.source AND b.node = e.dst AND b.dist = a.dist + e.weight)"""
FIRST = "SELECT source, node, pred FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY pd, pred) AS k FROM p) WHERE k = 1"
LAST = "SELECT source, node, pred FROM (SELECT *, row_number() OVER (PARTITION BY source, node ORDER BY pd DESC, pred DESC) AS k FROM p) WHERE k = 1"


@query("g1_shortest_paths", f"""WITH RECURSIVE {NATIONS}, f AS ({FIRST})
    SELECT d.source, d.node, dist, pred FROM d LEFT JOIN f ON f.source = d.source AND f.node = d.node""")
def shortest(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source"))
    return G.shortest_paths(nation_edges(spark, sf), nations)


@query("g1_unreachable", f"""WITH RECURSIVE {NATIONS}, f AS ({FIRST}), n AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation
      UNION ALL SELECT 1000 + r_regionkey FROM region)
    SELECT CAST(3 AS BIGINT) AS source, n.node, coalesce(dist, 16000000) AS dist, pred FROM n LEFT JOIN d ON d.source = 3 AND d.node = n.node
    LEFT JOIN f ON f.source = 3 AND f.node = n.node""")
def unreachable(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    nodes = nations.unionByName(table(spark, sf, "region").select((1000 + F.col("r_regionkey").cast("long")).alias("node")))
    three = nations.filter("node = 3")
    found = G.with_unreachable(G.shortest_paths(nation_edges(spark, sf), three), nodes, 3)
    return found.select(F.col("source").cast("long").alias("source"), "node", "dist", "pred")


def user_edges(spark, sf):
    """Each event's user -> the user of the next event of its type."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    line = Timeline(events, ["event_type"], ["ts", "event_id"])
    rows = line.scan(previous={"src": F.col("user_id"), "_event": F.col("event_id")}).frame
    return rows.filter("src IS NOT NULL AND src <> user_id").select("src", F.col("user_id").alias("dst"), (1 + F.col("_event") % 9).alias("weight"))


@query("g1_user_graph", """WITH RECURSIVE x AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst,
      1 + event_id % 9 AS w FROM events), e AS (SELECT src, dst, min(w) AS weight FROM x WHERE dst IS NOT NULL AND src <> dst GROUP BY 1, 2),
    r(node, dist) AS (SELECT min(user_id), CAST(0 AS BIGINT) FROM events UNION SELECT e.dst, r.dist + e.weight FROM r JOIN e ON r.node = e.src WHERE r.dist + e.weight <= 40)
    SELECT (SELECT min(user_id) FROM events) AS source, node, min(dist) AS dist FROM r GROUP BY node""")
def user_graph(spark, sf):
    start = table(spark, sf, "events").agg(F.min("user_id").alias("source"))
    return G.distances(user_edges(spark, sf), start)


@query("g2_equal_cost", f"WITH RECURSIVE {NATIONS} SELECT source, node, pred FROM p")
def equal_cost(spark, sf):
    edges = G.simple_edges(nation_edges(spark, sf))
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source"))
    return G.equal_cost(edges, G.distances(edges, nations)).select("source", "node", "pred")


def nation_routes(spark, sf, edges=None):
    edges = edges if edges is not None else G.simple_edges(nation_edges(spark, sf))
    return G.routes(edges, edges.select(F.col("src").alias("source"), F.col("dst").alias("target")))


PATH = f"""best AS ({LAST}), path(source, target, step, node) AS (SELECT src, dst, CAST(1 AS BIGINT), dst FROM e
      UNION ALL SELECT path.source, target, step + 1, best.pred FROM path JOIN best ON best.source = path.source AND best.node = path.node WHERE best.pred <> path.source)"""


@query("g3_metric_and_path", f"""WITH RECURSIVE {NATIONS}, {PATH} SELECT path.source, target, dist, step, path.node FROM path
    JOIN d ON d.source = path.source AND d.node = target""")
def metric_and_path(spark, sf):
    metric, path, _ = nation_routes(spark, sf)
    return metric.join(path, ["source", "target"]).select("source", "target", "dist", "step", "node")


@query("g3_equal_cost_hops", f"""WITH RECURSIVE {NATIONS}, walk(source, target, node) AS (SELECT src, dst, dst FROM e
      UNION ALL SELECT w.source, w.target, p.pred FROM walk w JOIN p ON p.source = w.source AND p.node = w.node WHERE p.pred <> w.source)
    SELECT w.source, w.target, w.node, p.pred, count(*) AS paths FROM walk w JOIN p ON p.source = w.source AND p.node = w.node GROUP BY ALL""")
def hops(spark, sf):
    return nation_routes(spark, sf)[2].withColumn("paths", F.col("paths").cast("long"))


# From each nation to the nation that has its region's number.
ASKED = "SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_regionkey AS BIGINT) AS target FROM nation"


@query("g3_pair_routes", f"""WITH RECURSIVE {NATIONS}, best AS ({LAST}),
    asked AS ({ASKED}), path(source, target, step, node) AS (SELECT source, target, CAST(1 AS BIGINT), target FROM asked WHERE source <> target
      UNION ALL SELECT path.source, target, step + 1, best.pred FROM path JOIN best ON best.source = path.source AND best.node = path.node WHERE best.pred <> path.source)
    SELECT path.source, target, dist, step, path.node FROM path JOIN d ON d.source = path.source AND d.node = target""")
def pair_routes(spark, sf):
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("source"), F.col("n_regionkey").cast("long").alias("target"))
    metric, path, _ = G.pair_routes(nation_edges(spark, sf), asked)
    return metric.join(path, ["source", "target"]).select("source", "target", "dist", "step", "node")


def sightings(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select("ts", "event_id", (u % 8).alias("src_dpid"), (e % 16).alias("src_port"),
                                             ((u + e) % 8).alias("dst_dpid"))


@query("g4_graph_from_links", """WITH s AS (SELECT ts, event_id, user_id % 8 AS src, event_id % 16 AS port, (user_id + event_id) % 8 AS dst FROM events),
    l AS (SELECT *, row_number() OVER (PARTITION BY src, port ORDER BY ts DESC, event_id DESC) AS k FROM s WHERE src <> dst),
    m AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ts DESC, event_id DESC) AS j FROM l WHERE k = 1)
    SELECT src, dst, CAST(1 AS BIGINT) AS weight, port FROM m WHERE j = 1""")
def from_links(spark, sf):
    return G.graph_from_links(sightings(spark, sf), ["ts", "event_id"])


@query("g5_topology_tables", f"""WITH {TOPOLOGY}, {LINKS} SELECT 'node ' || t AS what, k AS a, '' AS b FROM (
      SELECT 'switch' AS t, dpid AS k FROM switch UNION SELECT 'port', port_id FROM port UNION SELECT 'device', dl_addr FROM host)
    UNION ALL SELECT 'edge out', p.dpid, port_id FROM port p JOIN switch s ON s.dpid = p.dpid
    UNION ALL SELECT 'edge out', port_id, dl_addr FROM port JOIN host ON host."desc" = port."desc" UNION ALL SELECT 'edge link', src, dst FROM link""")
def topology_tables(spark, sf):
    nodes, edges = G.topology_tables(*topology(spark, sf), port_links(spark, sf))
    return nodes.select(F.concat(F.lit("node "), "type").alias("what"), F.col("key").alias("a"), F.lit("").alias("b")).unionByName(
        edges.select(F.concat(F.lit("edge "), "label").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b")))


PLACED = """dev AS (SELECT dl_addr, p.dpid, p.number FROM host JOIN port p ON p."desc" = host."desc"),
    o AS (SELECT dl_addr, dpid, number AS port, (SELECT max(q.number) FROM port q WHERE q.dpid = dev.dpid AND q.number <> dev.number) AS other FROM dev),
    pr AS (SELECT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS src, 'Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0') AS dst FROM customer),
    f AS (SELECT src, dst, a.dpid AS ad, a.port AS ap, a.other AS ao, b.dpid AS bd, b.port AS bp, b.other AS bo,
          coalesce(CAST(a.port AS VARCHAR), 'null') || '/' || a.dpid || '/' || coalesce(CAST(a.other AS VARCHAR), 'null') || ',' ||
          coalesce(CAST(b.other AS VARCHAR), 'null') || '/' || b.dpid || '/' || CAST(b.port AS VARCHAR) AS summary
          FROM pr JOIN o a ON a.dl_addr = src JOIN o b ON b.dl_addr = dst)"""


@query("g6_flow_table", f"""WITH {TOPOLOGY}, {PLACED}
    SELECT src, dst, ad AS switch, ap AS in_port, ao AS out_port, 'src forward' AS side, summary FROM f UNION ALL SELECT src, dst, ad, ao, ap, 'src reverse', summary FROM f
    UNION ALL SELECT src, dst, bd, bo, bp, 'dst forward', summary FROM f UNION ALL SELECT src, dst, bd, bp, bo, 'dst reverse', summary FROM f""")
def flows(spark, sf):
    _, ports, hosts = topology(spark, sf)
    devices = hosts.join(ports, "desc").select("dl_addr", "dpid", "number")
    def name(key):
        return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))
    pairs = table(spark, sf, "customer").select(name(F.col("c_custkey")).alias("src"), name(F.col("c_custkey") + 1).alias("dst"))
    return G.flow_table(pairs, devices, ports.select("dpid", "number"))


@query("g7_hop_table", f"""WITH RECURSIVE {NATIONS}, {PATH}, n AS (SELECT source, target, max(step) AS n FROM path GROUP BY 1, 2),
    a AS (SELECT source, target, CAST(0 AS BIGINT) AS hop, source AS switch FROM n UNION ALL SELECT path.source, path.target, n - step + 1, node FROM path
          JOIN n ON n.source = path.source AND n.target = path.target),
    b AS (SELECT *, lag(switch) OVER w AS prev, lead(switch) OVER w AS nxt FROM a WINDOW w AS (PARTITION BY source, target ORDER BY hop))
    SELECT source, target, hop, switch, CASE WHEN prev IS NULL THEN source * 100 ELSE switch * 31 + prev END AS in_port,
    CASE WHEN nxt IS NULL THEN target * 100 + 1 ELSE switch * 31 + nxt END AS out_port FROM b
    UNION ALL SELECT n_nationkey, n_nationkey, 0, n_nationkey, n_nationkey * 100, n_nationkey * 100 + 1 FROM nation""")
def hop_table(spark, sf):
    edges = G.simple_edges(nation_edges(spark, sf))
    _, path, _ = nation_routes(spark, sf, edges)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    exits = both.withColumn("port", F.col("src") * 31 + F.col("dst"))
    same = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_nationkey").alias("dst"))
    ends = edges.select("src", "dst").unionByName(same).select(F.col("src").alias("source"), F.col("dst").alias("target"), (F.col("src") * 100).alias("first_port"),
                        (F.col("dst") * 100 + 1).alias("last_port"))
    return G.hop_table(path, exits, ends)
