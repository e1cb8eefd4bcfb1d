"""Order-dependent work that does not put a whole key into one task.

A plain window over (key order by ts) gives all rows of a key to one task. `Timeline` finds the keys with more rows than a
task should take, cuts each at quantiles of its order into chunks, and runs the window per (key, chunk): one shuffle, of
which further scans of the chain make use. A one-row summary of each chunk is carried to the chunks behind it.

`number_rows` gives consecutive numbers in a total order without a global window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsframe.plans.session import cut

# Rows of one key that one task takes, unless the session sets it.
ROWS_PER_TASK = 1_000_000
ROWS_PER_TASK_SETTING = "opsframe.rowsPerTask"
CHUNK_BITS = 12  # a key is cut into 2 ** CHUNK_BITS chunks at most
SAMPLE = 32  # rows per chunk from which the cut points are read
_CHUNK = "_chunk"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on `keys` in which null equals null; the right keys are dropped."""
    right = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(right, on, how).drop(*[f"_k_{k}" for k in keys])


def cut_points(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame | None:
    """(keys, _cuts) for the keys with more than `limit` rows, from a table: the places, as structs of the order columns, at
    which chunks of about limit / 2 rows begin. None where there is no such key.

    A first pass counts rows per key; it combines before its shuffle. A second, over these keys alone, samples rows by the
    hash of their order columns, SAMPLE for each chunk, and takes quantiles of them. Both depend on the rows alone.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = cut(sizes.withColumn("_parts", F.least(F.lit(1 << CHUNK_BITS), F.ceil(2 * F.col("_n") / limit)).cast("int")))
    if hot.isEmpty():
        return None
    rows = join_null_safe(df.select(*dict.fromkeys([*keys, *order])), hot, keys, "inner")
    some = rows.filter(F.pmod(F.xxhash64(*order), F.col("_n")) < SAMPLE * F.col("_parts"))
    listed = some.groupBy(*keys).agg(F.first("_parts").alias("_parts"), F.sort_array(F.collect_list(F.struct(*order))).alias("_all"))
    places = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.floor(i * F.size("_all") / F.col("_parts")).cast("int"))
    return cut(listed.select(*keys, F.transform(F.array_distinct(places), lambda i: F.get("_all", i)).alias("_cuts")))


def with_chunks(df: DataFrame, keys: list[str], order: list[str], rows_per_task: int) -> tuple[DataFrame, bool]:
    """Add `_chunk`: 0 for a key that isn't cut, else the number (from 1) of the row's chunk; and whether any key is cut.

    The chunk is found by binary search among the key's cut points. There are as many of these as chunks, so few, and
    only cut keys have any.
    """
    cuts = cut_points(df, keys, order, rows_per_task)
    if cuts is None:
        return df.withColumn(_CHUNK, F.lit(0).cast("long")), False
    here = F.struct(*order)
    found = F.aggregate(F.sequence(F.lit(CHUNK_BITS - 1), F.lit(0)), F.lit(0), lambda low, bit: F.when(
        F.get("_cuts", low + F.call_function("shiftleft", F.lit(1), bit) - 1) <= here, low + F.call_function("shiftleft", F.lit(1), bit)).otherwise(low))
    rows = join_null_safe(df, cuts, keys, "left")
    return rows.withColumn(_CHUNK, F.when(F.col("_cuts").isNull(), 0).otherwise(found + 1).cast("long")).drop("_cuts"), True


class Timeline:
    """Rows of each key in order. `order` must be total within a key.

    Making one counts the rows of each key. The rows aren't written: each action computes them anew.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows_per_task: int | None = None):
        self.keys, self.order = list(keys), list(order)
        limit = rows_per_task or int(df.sparkSession.conf.get(ROWS_PER_TASK_SETTING, str(ROWS_PER_TASK)))
        self._rows, self._is_cut = with_chunks(df, self.keys, self.order, limit)

    @property
    def frame(self) -> DataFrame:
        return self._rows.drop(_CHUNK)

    def map(self, fn) -> Timeline:
        """Apply a narrow DataFrame -> DataFrame function that keeps keys, order columns and chunks."""
        other = object.__new__(Timeline)
        other.keys, other.order, other._rows, other._is_cut = self.keys, self.order, fn(self._rows), self._is_cut
        return other

    def scan(self, previous: dict[str, Column] | None = None, running: dict[str, Column] | None = None,
             known: dict[str, Column] | None = None) -> Timeline:
        """Add columns computed along the order, all in one shuffle, which later scans share.

        Where keys are cut, a first job makes the carries, a row for each chunk of these keys, and writes them.

        previous: value on the row before (null on the first row)
        running:  sum up to and including this row
        known:    last non-null value up to and including this row
        """
        previous, running, known = previous or {}, running or {}, known or {}
        here = Window.partitionBy(*self.keys, _CHUNK).orderBy(*self.order)
        upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = F.struct(*self.order)

        inputs = {f"_v_{n}": c for n, c in {**previous, **running, **known}.items()}
        rows = self._rows.withColumns(inputs)
        prior = F.struct(F.lit(True).alias("_is"), *[F.col(f"_v_{n}").alias(n) for n in previous])

        local = {"_l_prior": F.lag(prior).over(here)} if previous else {}
        local |= {f"_l_{n}": F.sum(f"_v_{n}").over(upto) for n in running}
        local |= {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(upto) for n in known}
        joined = rows.withColumns(local)
        if not self._is_cut:
            out = {n: F.col(f"_l_prior.{n}") for n in previous} | {n: F.col(f"_l_{n}") for n in [*running, *known]}
            kept = [c for c in joined.columns if c[:3] not in ("_v_", "_l_") and c not in out]
            return self.map(lambda _: joined.select(*kept, *[c.alias(n) for n, c in out.items()]))

        tails = [F.max_by(prior, at).alias("_t_prior")] if previous else []
        tails += [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in running]
        tails += [F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), at)).alias(f"_t_{n}") for n in known]
        summary = rows.filter(F.col(_CHUNK) > 0).groupBy(*self.keys, _CHUNK).agg(*tails)

        chunks = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        before = chunks.rowsBetween(Window.unboundedPreceding, -1)
        carried = [F.lag("_t_prior").over(chunks).alias("_c_prior")] if previous else []
        carried += [F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in running]
        carried += [F.last(f"_t_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in known]
        carry = cut(summary.select(*self.keys, _CHUNK, *carried))
        joined = join_null_safe(joined, carry, [*self.keys, _CHUNK], "left")
        if previous:
            joined = joined.withColumn("_prior", F.coalesce("_l_prior", "_c_prior"))
        out = {n: F.col(f"_prior.{n}") for n in previous}
        out |= {n: F.when(F.col(f"_c_{n}").isNull(), F.col(f"_l_{n}")).otherwise(
            F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.col(f"_c_{n}")) for n in running}
        out |= {n: F.coalesce(f"_l_{n}", f"_c_{n}") for n in known}
        helpers = [c for c in joined.columns if c[:3] in ("_v_", "_l_", "_c_") or c == "_prior"]
        kept = [c for c in joined.columns if c not in helpers and c not in out]
        result = joined.select(*kept, *[c.alias(n) for n, c in out.items()])
        return self.map(lambda _: result)


def number_rows(df: DataFrame, order: list, name: str = "row_no", start: int | Column = 0) -> DataFrame:
    """Consecutive numbers from `start` in the given total order.

    Range partitioning spreads any distribution over the tasks; the sorted rows are checkpointed so
    that the partition sizes and the rows come from the same run. The offsets table has one row per
    partition, the only thing that passes through a single task.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = cut(sorted_rows.withColumn("_no_mid", F.monotonically_increasing_id()))
    in_part = F.col("_no_mid").bitwiseAND(F.lit((1 << 33) - 1))
    marked = marked.withColumns({"_no_part": F.shiftright("_no_mid", 33).cast("int"), "_no_at": in_part})
    sizes = marked.groupBy("_no_part").agg((F.max("_no_at") + 1).alias("_no_n"))
    before = Window.orderBy("_no_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_no_part", F.coalesce(F.sum("_no_n").over(before), F.lit(0)).alias("_no_off"))
    start = F.lit(start) if isinstance(start, int) else start
    numbered = marked.join(F.broadcast(offsets), "_no_part").withColumn(name, (start + F.col("_no_off") + F.col("_no_at")).cast("long"))
    return numbered.drop("_no_mid", "_no_part", "_no_at", "_no_off")
