"""Joins: foreign keys and nesting, id lists, topology, subnets, as-of lookups, snapshot differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.operators.paging import slice_rows
from opsframe.plans.model import SEP, Model, join_path_columns
from opsframe.plans.ordered import Timeline


def _pairings(df: DataFrame) -> int:
    """The joins of a plan that compare all rows of two sides."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin")


def comma_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """FROM a, b WHERE condition, which must hold an equality of the two: it becomes an equi-join.

    Without one, each row would meet all rows of the other table; that is refused.
    """
    joined = left.join(right).filter(condition)
    if _pairings(joined) > _pairings(left) + _pairings(right):
        raise ValueError("the condition has no equality between the two tables")
    return joined


def embed(model: Model, relations: list[str], how: str = "left") -> DataFrame:
    """Replace the key column of each requested relation by the related row; a null key stays null.

    Relations are paths; `customer__nation` nests nation inside customer.
    """
    wanted = {p for r in relations for p in (SEP.join(r.split(SEP)[:i + 1]) for i in range(r.count(SEP) + 1))}

    def columns_of(m: Model, prefix: str) -> list[str]:
        inner = [c for rel in m.links if f"{prefix}{rel}" in wanted
                 for c in columns_of(m.links[rel].model, f"{prefix}{rel}{SEP}")]
        return [prefix + c for c in m.columns] + inner

    joined = join_path_columns(model, [c for c in columns_of(model, "") if SEP in c], how)

    def nested(m: Model, prefix: str) -> list[Column]:
        out = []
        by_column = {m.links[r].column: r for r in m.links if f"{prefix}{r}" in wanted}
        for c in m.columns:
            if c in by_column:
                below = f"{prefix}{by_column[c]}{SEP}"
                target = m.links[by_column[c]].model
                row = F.struct(*nested(target, below))
                out.append(F.when(F.col(f"{below}{target.key}").isNotNull(), row).alias(c))
            else:
                out.append(F.col(prefix + c).alias(c))
        return out

    return joined.select(*nested(model, ""))


def split_nested(df: DataFrame, column: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Inverse of `embed`: the rows with the plain key, and the distinct related rows."""
    parents = df.withColumn(column, F.col(f"{column}.{key}"))
    related = df.filter(F.col(column).isNotNull()).select(f"{column}.*").distinct()
    return parents, related


def chosen(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the id frame."""
    return df.join(ids.select(F.col(ids.columns[0]).alias("_id")), F.col(key) == F.col("_id"), "left_semi")


def related_choices(related: DataFrame, key: str, label: str, nullable: bool, text: str | None = None,
                    page_no: int = 1, size: int = 15) -> DataFrame:
    """(id, repr) choices by label, optionally containing `text`; a None choice on top when nullable."""
    found = related.filter(F.col(label).ilike(f"%{text}%")) if text else related
    shown = found.select(F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("repr"), F.col(key).alias("_k"))
    rows = slice_rows(shown, ["repr", "_k"], (max(page_no, 1) - 1) * size, size)
    rows = rows.select(F.lit(1).alias("rank"), "id", "repr")
    if nullable:
        none = related.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit("__None").alias("id"), F.lit("None").alias("repr"))
        rows = none.unionByName(rows)
    return rows.orderBy("rank", "repr", "id")


def choices_around(related: DataFrame, label: str, text: str | None = None, page_no: int = 1, size: int = 15) -> DataFrame:
    """One row: prev_page and next_page of a page of `related_choices`, 0 where there is none."""
    found = related.filter(F.col(label).ilike(f"%{text}%")) if text else related
    now = max(page_no, 1)
    pages = F.ceil(F.count(F.lit(1)) / size)
    return found.agg(F.lit(now - 1).cast("long").alias("prev_page"), F.when(pages > now, now + 1).otherwise(0).cast("long").alias("next_page"))


# --- topology ------------------------------------------------------------------------------------

def switch_ports(switches: DataFrame, ports: DataFrame) -> DataFrame:
    """out edges switch -> port, by the switch id the port carries."""
    return ports.join(switches.select("dpid"), "dpid").select(F.col("dpid").alias("src"), F.col("port_id").alias("dst"),
                                                              F.lit("out").alias("label"))


def port_devices(ports: DataFrame, hosts: DataFrame) -> DataFrame:
    """out edges port -> device, by port name. hosts: (port name `desc`, `dl_addr`)."""
    return ports.join(hosts.select("desc", "dl_addr"), "desc").select(F.col("port_id").alias("src"),
                                                                      F.col("dl_addr").alias("dst"), F.lit("out").alias("label"))


def link_ports(ports: DataFrame, links: DataFrame) -> DataFrame:
    """link edges between the ports named by (src_dpid, src_port, dst_dpid, dst_port)."""
    def end(side: str) -> DataFrame:
        return ports.select(F.col("dpid").alias(f"{side}_dpid"), F.col("number").alias(f"{side}_port"),
                            F.col("port_id").alias(side))

    both = links.join(end("src"), ["src_dpid", "src_port"]).join(end("dst"), ["dst_dpid", "dst_port"])
    return both.select("src", "dst", F.lit("link").alias("label"))


def connected(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (a, b) that have an edge in either direction."""
    one = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    both = one.unionByName(one.select(F.col("_d").alias("_s"), F.col("_s").alias("_d")))
    return pairs.join(both, (F.col("a") == F.col("_s")) & (F.col("b") == F.col("_d")), "left_semi")


# --- addresses -----------------------------------------------------------------------------------

def ip_to_int(text: Column) -> Column:
    """Dotted IPv4 text as a number; null when it is not one."""
    parts = F.split(text, r"\.")
    octets = [F.get(parts, F.lit(i)).try_cast("int") for i in range(4)]
    valid = reduce(lambda a, b: a & b, [o.between(0, 255) for o in octets], F.size(parts) == 4)
    value = reduce(lambda a, b: a * 256 + b, [o.cast("long") for o in octets])
    return F.when(valid, value)


def int_to_ip(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def segment_of(addresses: DataFrame, ip: str, segments: DataFrame, network: str, mask: str) -> DataFrame:
    """Assign each address to the segment that covers it; the longest mask wins, null when none does.

    A mask must be ones followed by zeros, so there are at most 33 different ones; any other is an error. Each distinct
    address is looked up once per mask in use by an equi-join on (mask, address AND mask), so no range join and no pairs
    of addresses arise.
    """
    number = ip_to_int(F.col(mask))
    hosts = F.lit(0xFFFFFFFF) - number
    whole = number.isNull() | (hosts.bitwiseAND(hosts + 1) == 0)
    checked = F.when(whole, number).otherwise(F.raise_error(F.concat(F.lit("not a contiguous mask: "), F.col(mask))).cast("long"))
    nets = segments.withColumns({"_m": checked, "_net": ip_to_int(F.col(network))})
    nets = nets.withColumn("_net", F.col("_net").bitwiseAND(F.col("_m")))
    masks = nets.agg(F.sort_array(F.collect_set("_m")).alias("_masks"))
    values = addresses.select(F.col(ip).alias("_ip")).distinct().withColumn("_a", ip_to_int(F.col("_ip")))
    tries = values.filter(F.col("_a").isNotNull()).join(F.broadcast(masks)).select(
        "_ip", "_a", F.explode("_masks").alias("_m")).withColumn("_net", F.col("_a").bitwiseAND(F.col("_m")))
    hits = tries.join(nets.select("_m", "_net", F.struct(*segments.columns).alias("_seg")), ["_m", "_net"])
    best = hits.groupBy("_ip").agg(F.max_by("_seg", F.struct("_m", F.struct("_seg.*"))).alias("_seg"))
    return addresses.join(best, F.col(ip) == F.col("_ip"), "left").select(*addresses.columns, "_seg.*")


# --- as-of and differences -----------------------------------------------------------------------

FLOOD = "FLOOD"


def learned_port(packets: DataFrame, switch: str = "switch", src: str = "src", dst: str = "dst", port: str = "in_port",
                 order: list[str] = ("ts", "seq"), rows_per_task: int | None = None) -> DataFrame:
    """For each packet the port last learnt for its destination on that switch, else FLOOD.

    A packet teaches its own source first. Teaching and asking rows form one timeline per
    (switch, address); a hot address is cut into chunks.
    """
    order = list(order)
    teach = packets.select(F.col(switch).alias("_sw"), F.col(src).alias("_mac"), *order, F.lit(0).alias("_ask"),
                           F.col(port).alias("_port"), F.when(F.lit(False), F.struct(*packets.columns)).alias("_row"))
    ask = packets.select(F.col(switch).alias("_sw"), F.col(dst).alias("_mac"), *order, F.lit(1).alias("_ask"),
                         F.lit(None).cast(packets.schema[port].dataType).alias("_port"), F.struct(*packets.columns).alias("_row"))
    line = Timeline(teach.unionByName(ask), ["_sw", "_mac"], [*order, "_ask"], rows_per_task)
    seen = line.scan(known={"_out": F.col("_port")}).frame
    out = F.coalesce(F.col("_out").cast("string"), F.lit(FLOOD))
    return seen.filter("_ask = 1").select("_row.*", out.alias("out_port"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys added, deleted or moved between two snapshots: (key, change, old_*, new_*)."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*key, F.lit(True).alias(f"_{prefix}"), *[F.col(v).alias(f"{prefix}_{v}") for v in values])

    old = side(before, "old").withColumnsRenamed({k: f"_old_{k}" for k in key})
    new = side(after, "new").withColumnsRenamed({k: f"_new_{k}" for k in key})
    met = reduce(lambda a, b: a & b, [F.col(f"_old_{k}").eqNullSafe(F.col(f"_new_{k}")) for k in key])
    both = old.join(new, met, "full_outer").select(
        *[F.when(F.col("_old").isNull(), F.col(f"_new_{k}")).otherwise(F.col(f"_old_{k}")).alias(k) for k in key],
        "_old", "_new", *[f"{p}_{v}" for p in ("old", "new") for v in values])
    same = reduce(lambda a, b: a & b, [F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")) for v in values], F.lit(True))
    change = F.when(F.col("_old").isNull(), "add").when(F.col("_new").isNull(), "delete").when(~same, "move")
    return both.withColumn("change", change).filter("change IS NOT NULL").drop("_old", "_new")
