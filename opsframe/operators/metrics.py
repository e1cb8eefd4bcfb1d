"""Counter samples to rates, ratios, percentages and alerts.

Samples are wide rows (host, time, counters ...). Each function takes a `Timeline` of samples and
adds columns to it, so that several of them share one shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.plans.ordered import Timeline

# The sampled counters that become rates.
RATE_COUNTERS = [
    "Com_insert", "Com_update", "Com_delete", "Com_select",
    "Innodb_buffer_pool_read_requests", "Innodb_buffer_pool_reads",
    "Innodb_rows_inserted", "Innodb_rows_updated", "Innodb_rows_deleted", "Innodb_rows_read",
    "Innodb_buffer_pool_pages_flushed",
    "Innodb_data_reads", "Innodb_data_writes", "Innodb_data_read", "Innodb_data_written",
    "Innodb_os_log_fsyncs", "Innodb_os_log_written",
    "Threads_created", "Bytes_received", "Bytes_sent",
]
# Tick columns of a processor sample, and counters of a disk sample.
CPU_TICKS = ["user", "nice", "system", "idle", "iowait", "irq", "softirq"]
DISK_COUNTERS = ["rd_ios", "rd_sectors", "rd_ticks", "wr_ios", "wr_sectors", "wr_ticks", "ticks", "aveq"]
TICKS_PER_SECOND = 100


def differences(samples: Timeline, columns: list[str], first: str = "zero") -> Timeline:
    """Add d_<column>: the change since the previous sample of the host.

    On the first sample the change is 0 (`zero`) or counts from 0 (`whole`).
    """
    seen = samples.scan(previous={f"_p_{c}": F.col(c) for c in columns} | {"_has": F.lit(True)})

    def change(c: str) -> Column:
        base = F.col(c) - F.col(f"_p_{c}")
        start = F.col(c) if first == "whole" else (F.col(c) - F.col(c))
        return F.when(F.col("_has"), base).otherwise(start)

    return seen.map(lambda df: df.withColumns({f"d_{c}": change(c) for c in columns}).drop(
        "_has", *[f"_p_{c}" for c in columns]))


def with_difference_rates(df: DataFrame, columns: list[str], interval: float) -> DataFrame:
    return df.withColumns({f"{c}_rate": F.col(f"d_{c}") / F.lit(float(interval)) for c in columns})


def counter_rates(samples: Timeline, counters: list[str], interval: float = 1.0) -> Timeline:
    """<counter>_rate = (current - previous) / interval; 0 on the first sample."""
    return differences(samples, counters).map(lambda df: with_difference_rates(df, counters, interval).drop(
        *[f"d_{c}" for c in counters]))


def statement_rates(rates: DataFrame) -> DataFrame:
    """ins, upd, del, sel and iud = ins + upd + del from counter rates."""
    names = {"ins": "Com_insert_rate", "upd": "Com_update_rate", "del": "Com_delete_rate", "sel": "Com_select_rate"}
    out = rates.withColumns({n: F.col(c) for n, c in names.items()})
    return out.withColumn("iud", F.col("ins") + F.col("upd") + F.col("del"))


def hit_percent(requests: Column, reads: Column) -> Column:
    return F.when(requests > 0, (requests - reads) / requests * 100).otherwise(F.lit(100.0))


def cpu_percent(samples: Timeline) -> Timeline:
    """usr, sys, idl, iow in whole percent of all ticks since the previous sample, and their tick counts.

    The first sample counts from zero. Null when no tick passed.
    """
    def shares(df: DataFrame) -> DataFrame:
        d = {t: F.col(f"d_{t}") for t in CPU_TICKS}
        total = reduce(lambda a, b: a + b, d.values())
        parts = {"usr": d["user"] + d["nice"], "sys": d["system"] + d["irq"] + d["softirq"], "idl": d["idle"], "iow": d["iowait"]}
        percent = {n: F.floor(p / F.nullif(total, F.lit(0)) * 100 + 0.5) for n, p in parts.items()}
        counts = {f"{n}_ticks": p for n, p in parts.items()}
        return df.withColumns(percent | counts).drop(*[f"d_{t}" for t in CPU_TICKS])

    return differences(samples, CPU_TICKS, first="whole").map(shares)


def elapsed_ms(cpus: int) -> Column:
    """Milliseconds since the previous sample, from the tick counts of `cpu_percent`."""
    ticks = F.col("usr_ticks") + F.col("sys_ticks") + F.col("idl_ticks") + F.col("iow_ticks")
    return F.lit(1000.0) * ticks / F.lit(float(cpus)) / F.lit(float(TICKS_PER_SECOND))


def disk_rates(samples: Timeline, elapsed: Column) -> Timeline:
    """rs, ws, rkbs, wkbs, queue, await, svctm, util since the previous sample (the first counts from zero)."""
    def rates(df: DataFrame) -> DataFrame:
        d = {c: F.col(f"d_{c}").cast("double") for c in DISK_COUNTERS}
        ms = F.nullif(F.col("_ms"), F.lit(0.0))
        ios = F.nullif(d["rd_ios"] + d["wr_ios"], F.lit(0.0))

        def per_io(ticks: Column) -> Column:
            return F.coalesce(ticks / ios, F.lit(0.0))

        return df.withColumn("_ms", elapsed).withColumns({
            "rs": F.lit(1000.0) * d["rd_ios"] / ms, "ws": F.lit(1000.0) * d["wr_ios"] / ms,
            "rkbs": F.lit(1000.0) * d["rd_sectors"] / ms / 2, "wkbs": F.lit(1000.0) * d["wr_sectors"] / ms / 2,
            "queue": d["aveq"] / ms, "await": per_io(d["rd_ticks"] + d["wr_ticks"]), "svctm": per_io(d["ticks"]),
            "util": F.when(ms.isNotNull(), F.least(F.lit(100.0), F.lit(100.0) * d["ticks"] / ms)),
        }).drop("_ms", *[f"d_{c}" for c in DISK_COUNTERS])

    return differences(samples, DISK_COUNTERS, first="whole").map(rates)


def traffic_rates(samples: Timeline, net: list[str], swap: list[str], interval: float = 1.0) -> Timeline:
    """Net columns per second as numbers; swap columns as whole numbers, never below 0; first sample 0."""
    def rates(df: DataFrame) -> DataFrame:
        per = {c: F.col(f"d_{c}") / F.lit(float(interval)) for c in [*net, *swap]}
        out = {f"{c}_rate": per[c] for c in net}
        out |= {f"{c}_rate": F.greatest(F.lit(0), F.floor(per[c])) for c in swap}
        return df.withColumns(out).drop(*[f"d_{c}" for c in per])

    return differences(samples, [*net, *swap]).map(rates)


# Wording of the status report, and on which side of it the number stands.
STATUS_LINES = {
    "history_list": ("History list length", "after"),
    "log_bytes_written": ("Log sequence number", "after"),
    "log_bytes_flushed": ("Log flushed up to", "after"),
    "last_checkpoint": ("Last checkpoint at", "after"),
    "queries_inside": ("queries inside InnoDB", "before"),
    "queries_queued": ("queries inside InnoDB,", "after"),
    "read_views": ("read views open inside InnoDB", "before"),
}


def log_lag(df: DataFrame, text: str) -> DataFrame:
    """Numbers read out of a status text, plus unflushed and uncheckpointed log bytes. No shuffle.

    The last line with the wording counts. Plain substring search finds it; only the few characters
    beside it meet a regular expression.
    """
    def number(label: str, side: str) -> Column:
        whole = F.col(text)
        rest = F.substring_index(whole, label, -1)
        left = F.substr(whole, F.lit(1), F.length(whole) - F.length(rest) - F.lit(len(label)))
        digits = (F.regexp_extract(rest, r"^\s*(\d+)", 1) if side == "after" else
                  F.regexp_extract(F.substring_index(left, "\n", -1), r"(\d+)\s*$", 1))
        return F.when(F.contains(whole, F.lit(label)), digits.try_cast("bigint"))

    out = df.withColumns({n: number(*where) for n, where in STATUS_LINES.items()})
    return out.withColumns({"unflushed_log": F.col("log_bytes_written") - F.col("log_bytes_flushed"),
                            "uncheckpointed_bytes": F.col("log_bytes_written") - F.col("last_checkpoint")})


# Fixed values: (metric, comparison, limit or name of the limit column).
MIB = 1024 * 1024
RULES = [
    ("load1", ">", "ncpu"), ("load5", ">", "ncpu"), ("load15", ">", "ncpu"),
    ("usr", ">", 10), ("sys", ">", 10), ("iow", ">", 10),
    ("pswpin_rate", ">", 0), ("pswpout_rate", ">", 0),
    ("recv_rate", ">", 1024), ("send_rate", ">", 1024),
    ("rkbs", ">", 1024), ("wkbs", ">", 1024), ("await", ">", 5), ("svctm", ">", 5), ("util", ">", 80),
    ("hit", "<=", 99),
    ("Innodb_data_read_rate", ">", 9 * MIB), ("Innodb_data_written_rate", ">", 9 * MIB),
    ("Innodb_os_log_written_rate", ">", MIB),
    ("avg", ">", 10000), ("avg95", ">", 10000), ("avg99", ">", 10000),
]


def alerts(metrics: DataFrame, keep: list[str], time: str, rules=RULES) -> DataFrame:
    """One row per metric beyond its limit: kept columns, metric, msg, time, is_finished.

    The rules are a short fixed list, so they become one array expression per row: no join.
    """
    def row(metric: str, op: str, limit) -> Column:
        c = F.col(metric)
        edge = F.col(limit) if isinstance(limit, str) else F.lit(limit)
        beyond = c > edge if op == ">" else c <= edge
        return F.when(beyond, F.struct(F.lit(metric).alias("metric"), F.concat_ws(" ", F.lit(f"{metric} {op}"), edge).alias("msg")))

    names = {r[0] for r in rules} | {r[2] for r in rules if isinstance(r[2], str)}
    if missing := sorted(names - set(metrics.columns)):
        raise ValueError(f"no column for the rules on {missing}; pass the rules that apply")
    found = F.array_compact(F.array(*[row(*r) for r in rules]))
    return metrics.select(*keep, F.col(time).alias("time"), F.explode(found).alias("_a")).select(
        *keep, "_a.metric", "_a.msg", "time", F.lit(0).cast("long").alias("is_finished"))
