"""Shortest paths, equal-cost routes, topology and flow tables over edge frames (src, dst, weight).

Weights are whole numbers of at least 1. Each round joins only the nodes improved in the round before
with the edges; rounds are materialised with reliable checkpoints.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.operators.joins import link_ports, port_devices, switch_ports
from opsframe.plans.session import cut
from opsframe.sources.writes import new_rows

# Fixed value: the distance of unreachable nodes.
UNREACHABLE = 16_000_000
LAYERS = 8
COUNT = "decimal(38,0)"  # walks double with every diamond


def simple_edges(edges: DataFrame) -> DataFrame:
    """The lightest edge per (src, dst), materialised: every round and every follow-up step reads it."""
    return cut(edges.groupBy("src", "dst").agg(F.min(F.col("weight").cast("long")).alias("weight")))


def _settled(layers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, layers).groupBy("source", "node").agg(F.min("dist").alias("dist"))


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, dist) of every node reached from each source (first column of `sources`).

    The work grows with the improved (source, node) pairs, not with sources times nodes. Improvements
    are kept as layers and merged every few rounds.
    """
    return _relax(simple_edges(edges), sources)


def _relax(links: DataFrame, sources: DataFrame) -> DataFrame:
    start = sources.select(F.col(sources.columns[0]).alias("source")).distinct()
    frontier = cut(start.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("dist")))
    layers = [frontier]
    while True:
        reach = frontier.join(links, F.col("node") == F.col("src")).select(
            "source", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("dist"))
        best = reach.groupBy("source", "node").agg(F.min("dist").alias("dist"))
        known = _settled(layers).withColumnRenamed("dist", "_old")
        better = best.join(known, ["source", "node"], "left").filter(F.col("_old").isNull() | (F.col("dist") < F.col("_old")))
        frontier = cut(better.drop("_old"))
        if frontier.isEmpty():
            return cut(_settled(layers))
        layers.append(frontier)
        if len(layers) > LAYERS:
            layers = [cut(_settled(layers))]


def equal_cost(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(source, node, pred, pred_dist): every predecessor on some shortest path."""
    return _predecessors(simple_edges(edges), dist)


def _predecessors(links: DataFrame, dist: DataFrame) -> DataFrame:
    near = dist.select("source", F.col("node").alias("pred"), F.col("dist").alias("pred_dist"))
    steps = near.join(links, F.col("pred") == F.col("src")).select(
        "source", F.col("dst").alias("node"), "pred", "pred_dist", (F.col("pred_dist") + F.col("weight")).alias("dist"))
    return steps.join(dist, ["source", "node", "dist"]).select("source", "node", "pred", "pred_dist")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, dist, pred); the predecessor is the smallest (distance, id), null for the source."""
    links = simple_edges(edges)
    dist = _relax(links, sources)
    pred = _predecessors(links, dist).groupBy("source", "node").agg(F.min_by("pred", F.struct("pred_dist", "pred")).alias("pred"))
    return dist.join(pred, ["source", "node"], "left")


def with_unreachable(paths: DataFrame, nodes: DataFrame, source) -> DataFrame:
    """One source's rows for all nodes; unreachable ones have distance 16000000 and no predecessor."""
    every = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    mine = paths.filter(F.col("source") == F.lit(source)).drop("source")
    return every.join(mine, "node", "left").fillna(UNREACHABLE, ["dist"]).withColumn("source", F.lit(source))


PAIR = ["source", "target"]


def meetings(links: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Search from both ends of each (source, target) pair until the two sides have met for good.

    Gives best, (source, target, dist) of the pairs that are joined, and labels, (source, target, side, node, dist): how far
    a node is from the source (side 0) or to the target (side 1), exact for all nodes of shortest paths in that side's half.

    Each round moves both sides' improved labels one edge on. Once a pair has met at a distance, labels beyond half of it
    aren't moved: of a shortest path, the last node within half the distance from the source and all nodes behind the next
    one lie within it, so both sides reach that next node. So a pair costs two searches of half the distance.
    """
    ends = pairs.select(*PAIR).distinct()
    step = links.select(F.lit(0).alias("side"), F.col("src").alias("node"), F.col("dst").alias("_to"), "weight").unionByName(
        links.select(F.lit(1).alias("side"), F.col("dst").alias("node"), F.col("src").alias("_to"), "weight"))
    step = cut(step)
    frontier = cut(ends.select(*PAIR, F.lit(0).alias("side"), F.col("source").alias("node"), F.lit(0).cast("long").alias("dist")).unionByName(
        ends.select(*PAIR, F.lit(1).alias("side"), F.col("target").alias("node"), F.lit(0).cast("long").alias("dist"))))
    layers = [frontier]

    def labels() -> DataFrame:
        return reduce(DataFrame.unionByName, layers).groupBy(*PAIR, "side", "node").agg(F.min("dist").alias("dist"))

    while True:
        sides = labels().groupBy(*PAIR, "node").agg(*[F.min(F.when(F.col("side") == i, F.col("dist"))).alias(f"d{i}") for i in (0, 1)])
        best = cut(sides.groupBy(*PAIR).agg(F.min(F.col("d0") + F.col("d1")).alias("_best")).filter("_best IS NOT NULL"))
        within = frontier.join(best, PAIR, "left").filter(F.col("_best").isNull() | (2 * F.col("dist") <= F.col("_best")))
        reach = within.drop("_best").join(step, ["side", "node"]).groupBy(*PAIR, "side", F.col("_to").alias("node")).agg(
            F.min(F.col("dist") + F.col("weight")).alias("dist"))
        known = labels().withColumnRenamed("dist", "_old")
        better = reach.join(known, [*PAIR, "side", "node"], "left").filter(F.col("_old").isNull() | (F.col("dist") < F.col("_old")))
        frontier = cut(better.select(*PAIR, "side", "node", "dist"))
        if frontier.isEmpty():
            return best.withColumnRenamed("_best", "dist"), cut(labels())
        layers.append(frontier)
        if len(layers) > LAYERS:
            layers = [cut(labels())]


def pair_routes(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `routes`, by a search from both ends of each pair: nodes that no shortest path comes near aren't visited."""
    links = simple_edges(edges)
    metric, labels = meetings(links, pairs)
    forth = labels.filter("side = 0").select(*PAIR, "node", F.col("dist").alias("d0"))
    back = labels.filter("side = 1").select(*PAIR, "node", F.col("dist").alias("d1"))
    total = metric.select(*PAIR, F.col("dist").alias("_best"))
    met = forth.join(back, [*PAIR, "node"]).join(total, PAIR).filter(F.col("d0") + F.col("d1") == F.col("_best"))
    on = cut(met.select(*PAIR, "node", F.col("d0").alias("dist")))
    found = [on]
    # from the nodes where the sides met, along each side's labels to its end
    half = {"src": (forth.withColumnRenamed("d0", "_d"), "dst", -1),
            "dst": (back.join(total, PAIR).select(*PAIR, "node", (F.col("_best") - F.col("d1")).alias("_d")), "src", 1)}
    for end, (near, start, sign) in half.items():
        walk = on
        while True:
            steps = walk.join(links, F.col("node") == F.col(start)).select(*PAIR, F.col(end).alias("node"), (F.col("dist") + sign * F.col("weight")).alias("dist"))
            walk = cut(steps.join(near, [*PAIR, "node"]).filter("dist = _d").select(*PAIR, "node", "dist").distinct())
            if walk.isEmpty():
                break
            found.append(walk)
    nodes = cut(reduce(DataFrame.unionByName, found).distinct())
    one = nodes.select(*PAIR, F.col("node").alias("pred"), F.col("dist").alias("pred_dist")).join(links, F.col("pred") == F.col("src"))
    preds = one.select(*PAIR, F.col("dst").alias("node"), "pred", "pred_dist", (F.col("pred_dist") + F.col("weight")).alias("dist")).join(
        nodes, [*PAIR, "node", "dist"]).select(*PAIR, "node", "pred", "pred_dist")
    return _walk_back(metric, preds, PAIR)


def routes(edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For (source, target) pairs: metric rows, one path, and the hops of all equal-cost paths.

    metric: (source, target, dist); path: (source, target, step, node) from the target back, without
    the source, over the predecessor with the largest (distance, id); hops: (source, target, node,
    pred, paths), paths = in how many walks back from the target the hop occurs (a decimal of 38 digits; null beyond).
    """
    pairs = pairs.select("source", "target").distinct()
    links = simple_edges(edges)
    dist = _relax(links, pairs.select("source"))
    metric = cut(pairs.join(dist.select("source", F.col("node").alias("target"), "dist"), ["source", "target"]))
    return _walk_back(metric, _predecessors(links, dist), ["source"])


def _walk_back(metric: DataFrame, preds: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """metric, path and hops of `routes` from all predecessors (`by`, node, pred, pred_dist) on shortest paths."""
    last = preds.groupBy(*by, "node").agg(F.max_by("pred", F.struct("pred_dist", "pred")).alias("_last"))
    preds = cut(preds.join(last, [*by, "node"]).select(*by, "node", "pred", (F.col("pred") == F.col("_last")).alias("last")))

    # all walks of a pair advance together, one hop per round; `main` marks the single path among them
    walk = metric.filter("source <> target").select("source", "target", F.col("target").alias("node"),
                                                    F.lit(1).cast(COUNT).alias("paths"), F.lit(True).alias("main"))
    hops, step = [], 0
    while True:
        step += 1
        hop = walk.join(preds, [*by, "node"]).select("source", "target", "node", "pred", "paths",
                                                          (F.col("main") & F.col("last")).alias("main"), F.lit(step).cast("long").alias("step"))
        hops.append(cut(hop))
        if hops[-1].isEmpty():
            break
        walk = hops[-1].filter("pred <> source").groupBy("source", "target", F.col("pred").alias("node")).agg(
            F.try_sum("paths").cast(COUNT).alias("paths"), F.bool_or("main").alias("main"))
    walked = reduce(DataFrame.unionByName, hops)
    path = walked.filter("main").select("source", "target", "step", "node")
    return metric, path, walked.groupBy("source", "target", "node", "pred").agg(F.try_sum("paths").cast(COUNT).alias("paths"))


def graph_from_links(sightings: DataFrame, order: list[str]) -> DataFrame:
    """(src, dst, weight 1, port) from link sightings (src_dpid, src_port, dst_dpid, ...).

    A port's latest peer counts; between two switches the exit port seen last counts.
    """
    at = F.struct(*order)
    peers = sightings.filter("src_dpid <> dst_dpid").groupBy("src_dpid", "src_port").agg(
        F.max_by("dst_dpid", at).alias("dst"), F.max(at).alias("_at"))
    return peers.groupBy(F.col("src_dpid").alias("src"), "dst").agg(
        F.lit(1).cast("long").alias("weight"), F.max_by("src_port", F.struct("_at", "src_port")).alias("port"))


def topology_tables(switches: DataFrame, ports: DataFrame, hosts: DataFrame, links: DataFrame, known: DataFrame | None = None):
    """Nodes (type, key), created only when new, and edges (src, dst, label)."""
    made = [switches.select(F.lit("switch").alias("type"), F.col("dpid").alias("key")),
            ports.select(F.lit("port").alias("type"), F.col("port_id").alias("key")),
            hosts.select(F.lit("device").alias("type"), F.col("dl_addr").alias("key"))]
    nodes = reduce(DataFrame.unionByName, made)
    have = known if known is not None else nodes.limit(0)
    nodes = new_rows(nodes, have, ["type", "key"], ["type", "key"])
    edges = switch_ports(switches, ports).unionByName(port_devices(ports, hosts)).unionByName(link_ports(ports, links))
    return nodes, edges


def flow_table(pairs: DataFrame, devices: DataFrame, ports: DataFrame) -> DataFrame:
    """Flow entries of device pairs: (src, dst, switch, in_port, out_port, side, summary).

    devices: (dl_addr, dpid, number); ports: (dpid, number). The other port of a switch is its highest
    one that is not the device's. Each pair gives a forward and a reverse entry on both end switches.
    """
    top = ports.groupBy("dpid").agg(F.max("number").alias("_top"))
    second = ports.join(top, "dpid").filter("number < _top").groupBy("dpid").agg(F.max("number").alias("_second"))
    placed = devices.join(top, "dpid").join(second, "dpid", "left").select(
        "dl_addr", "dpid", F.col("number").alias("port"), F.when(F.col("number") < F.col("_top"), F.col("_top")).otherwise(F.col("_second")).alias("other"))

    def end(side: str) -> DataFrame:
        return placed.select(F.col("dl_addr").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("dpid", "port", "other")])

    both = pairs.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst")
    summary = F.format_string("%s/%s/%s,%s/%s/%s", *[F.col(c).cast("string") for c in (
        "src_port", "src_dpid", "src_other", "dst_other", "dst_dpid", "dst_port")])

    def entry(switch: str, in_port: str, out_port: str, side: str) -> Column:
        return F.struct(F.col(switch).alias("switch"), F.col(in_port).alias("in_port"), F.col(out_port).alias("out_port"), F.lit(side).alias("side"))

    entries = F.array(entry("src_dpid", "src_port", "src_other", "src forward"), entry("src_dpid", "src_other", "src_port", "src reverse"),
                      entry("dst_dpid", "dst_other", "dst_port", "dst forward"), entry("dst_dpid", "dst_port", "dst_other", "dst reverse"))
    return both.withColumn("summary", summary).select("src", "dst", "summary", F.explode(entries).alias("_e")).select(
        "src", "dst", "_e.switch", "_e.in_port", "_e.out_port", "_e.side", "summary")


def hop_table(path: DataFrame, exits: DataFrame, ends: DataFrame) -> DataFrame:
    """Per hop of each route: (source, target, hop, switch, in_port, out_port).

    path: as from `routes`; exits: (src, dst, port); ends: (source, target, first_port, last_port), the
    ports of the two hosts. A route within one switch is one hop. The windows are per route, whose length the network's diameter bounds.
    """
    longest = path.groupBy("source", "target").agg(F.max("step").alias("_n"))
    origin = longest.select("source", "target", F.lit(0).cast("long").alias("hop"), F.col("source").alias("switch"))
    within = ends.filter("source = target").select("source", "target", F.lit(0).cast("long").alias("hop"), F.col("source").alias("switch")).distinct()
    along = path.join(longest, ["source", "target"]).select("source", "target", (F.col("_n") - F.col("step") + 1).alias("hop"), F.col("node").alias("switch"))
    w = Window.partitionBy("source", "target").orderBy("hop")
    rows = origin.unionByName(within).unionByName(along).withColumns({"_prev": F.lag("switch").over(w), "_next": F.lead("switch").over(w)})
    out = exits.select(F.col("src").alias("switch"), F.col("dst").alias("_next"), F.col("port").alias("_out"))
    back = exits.select(F.col("src").alias("switch"), F.col("dst").alias("_prev"), F.col("port").alias("_in"))
    joined = rows.join(out, ["switch", "_next"], "left").join(back, ["switch", "_prev"], "left").join(ends, ["source", "target"])
    return joined.select("source", "target", "hop", "switch",
                         F.when(F.col("_prev").isNull(), F.col("first_port")).otherwise(F.col("_in")).alias("in_port"),
                         F.when(F.col("_next").isNull(), F.col("last_port")).otherwise(F.col("_out")).alias("out_port"))
