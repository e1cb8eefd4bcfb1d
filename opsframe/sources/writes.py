"""Appending, updating and deleting rows.

Files are immutable, so updates and deletes return the new rows and `publish` writes them to a fresh
folder; the folder being read is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.plans.model import Model
from opsframe.plans.ordered import number_rows
from opsframe.plans.session import cut, scratch


def rows_of(spark: SparkSession, values: list, schema: T.StructType, without: tuple = ("id",)) -> DataFrame:
    """Rows from dicts (all keys) or objects (public attributes but `without`). All must share one key set."""
    dicts = [v if isinstance(v, dict) else
             {k: x for k, x in vars(v).items() if not k.startswith("_") and k not in without} for v in values]
    if not dicts:
        return spark.createDataFrame([], T.StructType([]))
    if any(d.keys() != dicts[0].keys() for d in dicts):
        raise ValueError("all rows must have the same keys")
    unknown = set(dicts[0]) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    kept = T.StructType([f for f in schema if f.name in dicts[0]])
    return spark.createDataFrame([tuple(d[n] for n in kept.names) for d in dicts], kept)


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the table's columns and types; missing columns are null, unknown ones an error."""
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ValueError(f"unknown columns {sorted(unknown)}")
    return rows.select([(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def with_ids(rows: DataFrame, target: DataFrame, key: str, order: list) -> DataFrame:
    """Number new rows consecutively after the largest key of the target."""
    top = target.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    numbered = number_rows(rows, order, "_new_no", start=1)
    return numbered.join(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_new_no")).drop("_top", "_new_no")


def append(rows: DataFrame, path: str, key: str | None = None, order: list | None = None, owner: tuple | None = None,
           fmt: str = "parquet") -> DataFrame | None:
    """Append rows to the table at `path` and return them with their ids. An empty batch writes nothing."""
    if not rows.columns:
        return None
    target = rows.sparkSession.read.format(fmt).load(path)
    if owner:
        rows = rows.withColumn(owner[0], F.lit(owner[1]))
    if key and key not in rows.columns:
        rows = with_ids(rows, target, key, order or rows.columns)
    rows = conform(rows, target.schema)
    rows.write.format(fmt).mode("append").save(path)
    return rows


def new_rows(rows: DataFrame, target: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """Rows whose unique key the target lacks; the first per key wins; null keys never conflict."""
    whole = F.col(key[0]).isNotNull()
    for k in key[1:]:
        whole = whole & F.col(k).isNotNull()
    first = rows.filter(whole).groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*seq)).alias("_row")).select("_row.*")
    fresh = first.join(target.select(*key), key, "left_anti")
    return fresh.select(*rows.columns).unionByName(rows.filter(~whole))


def insert_or_ignore(rows: DataFrame, path: str, key: list[str], seq: list[str], fmt: str = "parquet") -> None:
    target = rows.sparkSession.read.format(fmt).load(path)
    conform(new_rows(rows, target, key, seq).drop(*[c for c in seq if c not in target.columns]), target.schema).write.format(
        fmt).mode("append").save(path)


def matches(condition: Column) -> Column:
    """A null condition does not match."""
    return F.coalesce(condition, F.lit(False))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Set columns on the matching rows."""
    return df.withColumns({c: F.when(matches(condition), v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column, using: DataFrame | None = None) -> DataFrame:
    """Rows that stay. With `using`, a row goes if it matches together with any row of the other table."""
    if using is None:
        return df.filter(~matches(condition))
    return df.join(using, condition, "left_anti")


def change_counts(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows an update or delete touches, and how many there are."""
    return df.agg(F.count_if(matches(condition)).alias("matched"), F.count(F.lit(1)).alias("rows"))


def publish(df: DataFrame, name: str, fmt: str = "parquet") -> str:
    """Write a new version of a table to a fresh folder of the shared storage and return its path."""
    path = scratch(df.sparkSession, name)
    df.write.format(fmt).save(path)
    return path


def _referrers(models: list[Model], target: Model):
    return [(m, link) for m in models for link in m.links.values() if link.model is target]


def dependants(models: list[Model], root: Model, keys: DataFrame) -> list[tuple[Model, DataFrame]]:
    """Rows that reference the given keys through required links, directly or through others: (model, keys) by level.

    Each level's new keys are materialised once and lead to the next; it ends when no level finds new keys, so a
    table that references itself is followed as deep as its rows go. The given keys themselves are not listed.
    """
    start = keys.select(F.col(keys.columns[0]).alias("_gone")).distinct()
    known, frontier, found = {root.name: start}, [(root, start)], []
    while frontier:
        following = []
        for target, ids in frontier:
            for model, link in _referrers(models, target):
                if link.nullable:
                    continue
                hit = model.frame.join(ids, F.col(link.column) == F.col("_gone"), "left_semi").select(F.col(model.key).alias("_gone")).distinct()
                if model.name in known:
                    hit = hit.join(known[model.name], "_gone", "left_anti")
                new = cut(hit)
                if new.isEmpty():
                    continue
                known[model.name] = known[model.name].unionByName(new) if model.name in known else new
                found.append((model, new.withColumnRenamed("_gone", model.key)))
                following.append((model, new))
        frontier = following
    return found


def dependency_preview(models: list[Model], root: Model, keys: DataFrame) -> DataFrame:
    """(model, id) of all rows a cascade would remove, by model name; ids are text unless all are whole numbers."""
    out = None
    found = dependants(models, root, keys)
    whole = all(ids.schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") for _, ids in found)
    for model, ids in found:
        part = ids.select(F.lit(model.name).alias("model"), F.col(model.key).cast("long" if whole else "string").alias("id"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return keys.sparkSession.createDataFrame([], "model string, id long")
    return out.distinct().orderBy("model", "id")


def cascade_delete(models: list[Model], root: Model, keys: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting the keys and all that depends on them; nullable links to gone rows become null."""
    gone: dict[str, list[DataFrame]] = {root.name: [keys.select(F.col(keys.columns[0]).alias("_gone"))]}
    for model, ids in dependants(models, root, keys):
        gone.setdefault(model.name, []).append(ids.select(F.col(model.key).alias("_gone")))
    lost = {}
    for name, parts in gone.items():
        lost[name] = parts[0]
        for p in parts[1:]:
            lost[name] = lost[name].unionByName(p)
    out = {}
    for model in models:
        frame = model.frame
        for link in model.links.values():
            if link.nullable and link.model.name in lost:
                dead = lost[link.model.name].distinct().withColumn("_dead", F.lit(True))
                frame = frame.join(dead, F.col(link.column) == F.col("_gone"), "left").withColumn(
                    link.column, F.when(F.col("_dead").isNull(), F.col(link.column))).drop("_gone", "_dead")
        if model.name in lost:
            frame = frame.join(lost[model.name], F.col(model.key) == F.col("_gone"), "left_anti")
        out[model.name] = frame
    return out


def write_daily(df: DataFrame, path: str, time: str, fmt: str = "parquet") -> None:
    """One folder per day. The rebalance hint lets AQE split a large day over several files and merge small ones."""
    rows = df.withColumn("day", F.date_format(time, "yyyyMMdd"))
    rows.hint("rebalance", "day").write.format(fmt).partitionBy("day").mode("append").save(path)
