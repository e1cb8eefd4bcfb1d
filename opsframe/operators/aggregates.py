"""Aggregation: frequencies, batches, unique rows, mappings, run results, response times, utilisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsframe.plans.ordered import Timeline, join_null_safe, number_rows
from opsframe.plans.session import cut as materialised


def aggregate(df: DataFrame, group: list[str], **measures: str) -> DataFrame:
    """Group and aggregate by SQL expressions, e.g. total='sum(price)'."""
    return df.groupBy(*group).agg(*[F.expr(e).alias(n) for n, e in measures.items()])


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# --- frequency tables ----------------------------------------------------------------------------

def frequencies(df: DataFrame, value: str) -> DataFrame:
    """(value, n, share); the counts are small against the rows, so the total is taken from them."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def extreme(counts: DataFrame, most: bool = True) -> DataFrame:
    """All values with the largest (or smallest) count."""
    edge = counts.agg((F.max if most else F.min)("n").alias("_edge"))
    return counts.join(F.broadcast(edge), F.col("n") == F.col("_edge")).drop("_edge")


def by_count(counts: DataFrame, value: str) -> DataFrame:
    return counts.orderBy(F.col("n").desc(), F.col(value))


# --- sequences -----------------------------------------------------------------------------------

def batches(df: DataFrame, order: list[str], size: int, items: list[str]) -> DataFrame:
    """Consecutive groups of `size` rows, the last one short: (batch, items). Arrays are bounded by `size`."""
    numbered = number_rows(df.select(*dict.fromkeys([*order, *items])), order, "_at")
    packed = numbered.groupBy(F.floor(F.col("_at") / size).alias("batch")).agg(
        F.sort_array(F.collect_list(F.struct("_at", *items))).alias("_rows"))
    return packed.select("batch", F.transform("_rows", lambda r: F.struct(*[r[i].alias(i) for i in items])).alias("items"))


def unique_by(df: DataFrame, key: Column, seq: list[str]) -> DataFrame:
    """First row per key in sequence order. min_by combines on the map side, so a hot key is no burden."""
    at = F.struct(*seq)
    first = df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), at).alias("_row"))
    return first.select("_row.*")


def invert(df: DataFrame, key: str, value: str, seq: list[str]) -> DataFrame:
    """value -> last key that maps to it."""
    return df.groupBy(value).agg(F.max_by(key, F.struct(*seq)).alias(key))


def first_key(df: DataFrame, key: str, value: str, seq: list[str]) -> DataFrame:
    """value -> first key that maps to it."""
    return df.groupBy(value).agg(F.min_by(key, F.struct(*seq)).alias(key))


def keys_of(df: DataFrame, key: str, value: str, wanted) -> DataFrame:
    """All keys that map to a value, as rows: a value may have any number of keys."""
    return df.filter(F.col(value) == F.lit(wanted)).select(key).distinct().orderBy(key)


def merge_tables(frames: list[DataFrame], key: list[str], values: list[str]) -> DataFrame:
    """Keyed tables merged; the later table wins."""
    stacked = reduce(DataFrame.unionByName, [f.select(*key, *values, F.lit(i).alias("_prio")) for i, f in enumerate(frames)])
    won = stacked.groupBy(*key).agg(F.max_by(F.struct(*values), "_prio").alias("_row"))
    return won.select(*key, "_row.*")


def merge_maps(*maps: Column) -> Column:
    """Map columns merged, the later map winning."""
    def over(base: Column, later: Column) -> Column:
        kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(later, k), F.lit(False)))
        return F.when(later.isNull(), base).when(base.isNull(), later).otherwise(F.map_concat(kept, later))

    return reduce(over, maps)


def in_parts(df: DataFrame, group: list[str], order: list[str], size: int, items: list[str]) -> DataFrame:
    """Each group's rows as arrays of at most `size`: (group, part, items).

    The rows are numbered in (group, order) over range partitions, so a large group is never
    collected in one task.
    """
    numbered = number_rows(df.select(*dict.fromkeys([*group, *order, *items])), [*group, *order], "_at")
    starts = numbered.groupBy(*group).agg(F.min("_at").alias("_first"))
    rows = join_null_safe(numbered, starts, group, "inner").withColumn("part", F.floor((F.col("_at") - F.col("_first")) / size))
    packed = rows.groupBy(*group, "part").agg(F.sort_array(F.collect_list(F.struct("_at", *items))).alias("_rows"))
    return packed.select(*group, "part", F.transform("_rows", lambda r: F.struct(*[r[i].alias(i) for i in items])).alias("items"))


# --- run results ---------------------------------------------------------------------------------

# Modules whose outcome is their return code.
SHELL_MODULES = ["raw", "shell", "command", "script"]


def run_outcomes(runs: DataFrame) -> DataFrame:
    """(host, ..., status, detail): unreachable and failed runs are `failed`, others `ok`."""
    text = F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    shell = F.col("module").isin(SHELL_MODULES)
    bad = F.when(~F.col("reached"), True).when(shell, F.coalesce(F.col("rc") != 0, F.lit(True))).otherwise(
        F.coalesce("failed", F.lit(False)))
    detail = F.when(~F.col("reached"), F.col("msg")).when(shell, text).when(bad, F.col("msg")).otherwise(
        F.col("changed").cast("string"))
    return runs.withColumns({"status": F.when(bad, "failed").otherwise("ok"), "detail": detail})


def outcome_counts(runs: DataFrame) -> DataFrame:
    return run_outcomes(runs).groupBy("status").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("host").alias("hosts"))


def hosts_by_path(df: DataFrame, path: list[str], host: str) -> DataFrame:
    """(group, host) rows, group = the path columns joined by `->`. Missing columns are a blank step."""
    steps = [F.coalesce(F.col(p).cast("string"), F.lit("")) for p in path]
    return df.select(F.concat_ws("->", *steps).alias("group"), F.col(host).alias("host")).distinct()


def run_views(runs: DataFrame) -> DataFrame:
    """Per run: result (stdout, else stderr, else unreachable message), what it is, and timing."""
    out, err = F.nullif(F.col("stdout"), F.lit("")), F.nullif(F.col("stderr"), F.lit(""))
    kind = F.when(~F.col("reached"), "dark").when(out.isNotNull(), "stdout").when(err.isNotNull(), "stderr")
    return runs.withColumns({"kind": kind, "result": F.when(F.col("reached"), F.coalesce(out, err)).otherwise(F.col("msg"))})


def stderr_or_warnings(runs: DataFrame) -> DataFrame:
    """Reached runs that wrote to stderr or raised warnings."""
    noisy = (F.coalesce("stderr", F.lit("")) != "") | (F.coalesce("warnings", F.lit("")) != "")
    return runs.filter(F.col("reached") & noisy)


def run_durations(runs: DataFrame) -> DataFrame:
    """Per host: number of reached runs, total and longest duration in microseconds."""
    took = F.timestamp_diff("MICROSECOND", F.col("start"), F.col("end"))
    return runs.filter("reached").groupBy("host").agg(F.count(F.lit(1)).alias("runs"), F.sum(took).alias("total_us"),
                                                      F.max(took).alias("longest_us"))


def play_summary(runs: DataFrame) -> DataFrame:
    """Per host counts of ok, failures, unreachable, changed and skipped results."""
    done = run_outcomes(runs)
    reached, failed = F.col("reached"), F.col("status") == "failed"
    skipped = F.coalesce("skipped", F.lit(False)) if "skipped" in runs.columns else F.lit(False)
    return done.groupBy("host").agg(
        F.count_if(reached & ~failed & ~skipped).alias("ok"), F.count_if(reached & failed).alias("failures"),
        F.count_if(~reached).alias("unreachable"),
        F.count_if(reached & ~failed & ~skipped & F.coalesce("changed", F.lit(False))).alias("changed"),
        F.count_if(reached & skipped).alias("skipped"))


# --- response times ------------------------------------------------------------------------------

SKETCH = 1_000  # accuracy of the percentile sketch: its rank is off by a SKETCH-th of the rows at most


def _brackets(df: DataFrame, interval: list[str], value: str, percents) -> DataFrame:
    """(interval, _all, _brackets): the rows of each interval, and for each wanted rank a range of values that holds it.

    The sketch's ends lie three errors below and above the rank, so the true value lies between them. Where that is less
    than three rows, the only range is that of all values.
    """
    wanted = sorted({0.5, *(p / 100 for p in percents)})
    ends = [min(1.0, max(0.0, w + side * 3 / SKETCH)) for w in wanted for side in (-1, 1)]
    found = df.groupBy(*interval).agg(F.count(F.lit(1)).alias("_all"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                      F.percentile_approx(value, ends, SKETCH).alias("_p"))
    few = F.array(F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))
    some = F.array(*[F.struct(F.get("_p", F.lit(2 * i)).alias("lo"), F.get("_p", F.lit(2 * i + 1)).alias("hi")) for i in range(len(wanted))])
    return found.select(*interval, "_all", F.when(F.col("_all") < SKETCH, few).otherwise(some).alias("_brackets"))


def response_times(df: DataFrame, interval: list[str], value: str, percents=(95, 99),
                   rows_per_task: int | None = None) -> DataFrame:
    """Per interval: count, max, min, avg, med, std, and max/avg/std of the fastest p percent.

    `value` holds whole numbers (microseconds). A first pass brackets the ranks of the percents and of the middle by a
    mergeable sketch. The second counts equal values inside the brackets and adds up what lies between brackets in one row
    each; a running count over these rows finds how many of each belong to the fastest p percent and to the middle. So the
    shuffle holds a few thousandths of the rows, however many values differ, and a hot interval is cut by value. Null
    values don't count.
    """
    known = df.filter(F.col(value).isNotNull())
    totals = materialised(_brackets(known, interval, value, percents))
    v = F.col(value).cast("decimal(19,0)")
    inside = F.exists("_brackets", lambda x: (F.col(value) >= x["lo"]) & (F.col(value) <= x["hi"]))
    gap = F.size(F.filter("_brackets", lambda x: x["hi"] < F.col(value)))
    placed = join_null_safe(known.select(*interval, value), totals.drop("_all"), interval, "inner").withColumns(
        {"_gap": F.when(~inside, gap), "_value": F.when(inside, F.col(value))})
    counted = materialised(placed.groupBy(*interval, "_gap", "_value").agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_from"), F.max(value).alias("_to"), F.sum(v).alias("_sum"),
        F.sum((v * v).cast("decimal(30,0)")).alias("_square")))
    line = Timeline(counted, interval, ["_from"], rows_per_task).scan(running={"_upto": F.col("_n")}).frame
    rows = join_null_safe(line, totals.drop("_brackets"), interval, "inner").withColumn("_before", F.col("_upto") - F.col("_n"))

    def share(cutoff: Column) -> Column:
        """How many of a row's values lie below a rank: of a row between brackets all or none."""
        return F.greatest(F.lit(0), F.least(F.col("_n"), cutoff - F.col("_before"))).cast("long")

    def moments(take: Column, tag: str) -> list[Column]:
        whole, one = take == F.col("_n"), F.col("_value").cast("decimal(19,0)")
        return [F.sum(take).alias(f"_c{tag}"), F.sum(F.when(whole, F.col("_sum")).otherwise(one * take)).cast("double").alias(f"_s{tag}"),
                F.sum(F.when(whole, F.col("_square")).otherwise((one * one).cast("decimal(30,0)") * take)).cast("double").alias(f"_q{tag}"),
                F.max(F.when(take > 0, F.col("_to"))).alias(f"max{tag}")]

    low = F.floor((F.col("_all") - 1) / 2)
    high = F.floor(F.col("_all") / 2)
    mids = [F.max(F.when((F.col("_before") <= at) & (at < F.col("_upto")), F.col("_value"))) for at in (low, high)]
    cut = {f"{p}": F.floor(F.col("_all") * p / 100) for p in percents}
    sums = [m for tag, at in cut.items() for m in moments(share(at), tag)]
    agg = rows.groupBy(*interval).agg(*moments(F.col("_n"), ""), F.min("_from").alias("min"),
                                      ((mids[0] + mids[1]) / 2).alias("med"), *sums)

    def mean(tag: str) -> Column:
        return F.col(f"_s{tag}") / F.nullif(F.col(f"_c{tag}"), F.lit(0))

    def std(tag: str) -> Column:
        c = F.nullif(F.col(f"_c{tag}"), F.lit(0))
        return F.sqrt(F.greatest(F.lit(0.0), (F.col(f"_q{tag}") - F.col(f"_s{tag}") * F.col(f"_s{tag}") / c) / c))

    out = [F.col("_c").alias("count"), "max", "min", mean("").alias("avg"), "med", std("").alias("std")]
    for tag in cut:
        out += [F.col(f"max{tag}"), mean(tag).alias(f"avg{tag}"), std(tag).alias(f"std{tag}")]
    return agg.select(*interval, *out)


def segment_use(segments: DataFrame, pool: DataFrame, key: str, assigned: str = "assigned") -> DataFrame:
    """Total and assigned pool addresses per segment; segments without addresses show 0."""
    used = pool.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(assigned).cast("long")).alias("assigned"))
    return segments.join(used, key, "left").fillna(0, ["total", "assigned"])
