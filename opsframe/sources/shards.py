"""Modulo-sharded tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.plans.session import scratch
from opsframe.sources.writes import update_where

SHARD = "_shard"


@dataclass(frozen=True)
class ShardMap:
    """Nodes as (name, begin, end) ranges of hash values, both ends included."""

    nodes: tuple[tuple[str, int, int], ...]

    @property
    def modulus(self) -> int:
        return max(end for _, _, end in self.nodes) + 1

    def hash(self, value: Column) -> Column:
        return F.pmod(value, F.lit(self.modulus))

    def node(self, value: Column) -> Column:
        """Name of the node that holds the value, null when no range covers it."""
        h = self.hash(value)
        return F.coalesce(*[F.when(h.between(b, e), F.lit(n)) for n, b, e in self.nodes])

    def require_node(self, value: Column) -> Column:
        """Like `node`, but an uncovered value fails the job."""
        message = F.concat(F.lit("no node for shard value "), value.cast("string"))
        return F.coalesce(self.node(value), F.raise_error(message).cast("string"))

    def table(self, name: str, value: Column, formatter=None) -> Column:
        """`name_` and the hash, zero-padded to the digits of the modulus; or what the formatter returns."""
        if formatter:
            return formatter(name, self.hash(value))
        return F.concat(F.lit(f"{name}_"), F.lpad(self.hash(value).cast("string"), len(str(self.modulus)), "0"))


def write_sharded(df: DataFrame, shards: ShardMap, column: str, path: str, mode: str = "append") -> None:
    """One folder per hash value. Rebalancing splits a hot shard over several files."""
    shards_of = df.withColumn(SHARD, shards.hash(F.col(column)).cast("int"))
    shards_of.hint("rebalance", SHARD).write.partitionBy(SHARD).mode(mode).parquet(path)


def read_shard(spark: SparkSession, shards: ShardMap, column: str, value: int, path: str) -> DataFrame:
    """Rows of one shard value. Both predicates are needed: the value does not imply its folder to the optimizer."""
    rows = spark.read.parquet(path)
    return rows.filter((F.col(SHARD) == value % shards.modulus) & (F.col(column) == value)).drop(SHARD)


def delete_shard_rows(spark: SparkSession, shards: ShardMap, column: str, value: int, path: str, condition: Column) -> DataFrame:
    """Rows of the value's shard that stay after a delete; only that shard is read."""
    rows = spark.read.parquet(path).filter(F.col(SHARD) == value % shards.modulus)
    return rows.filter(~F.coalesce((F.col(column) == value) & condition, F.lit(False)))


def update_shard_rows(spark: SparkSession, shards: ShardMap, column: str, value: int, path: str, condition: Column,
                      values: dict[str, Column]) -> DataFrame:
    """Rows of the value's shard with columns set where the value and the condition match; only that shard is read."""
    rows = spark.read.parquet(path).filter(F.col(SHARD) == value % shards.modulus)
    return update_where(rows, (F.col(column) == value) & condition, values)


def replace_shard(rows: DataFrame, shards: ShardMap, value: int, path: str) -> None:
    """Write the value's shard anew from `rows` of `delete_shard_rows` or `update_shard_rows`; other folders stay untouched.

    The rows come from the folder that they replace, so they are written elsewhere first.
    """
    spark, held = rows.sparkSession, scratch(rows.sparkSession, "shard")
    rows.write.parquet(held)
    new = spark.read.schema(rows.schema).parquet(held)
    if new.isEmpty():  # a dynamic overwrite without rows leaves the folder as it is
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SHARD}={value % shards.modulus}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    else:
        new.hint("rebalance", SHARD).write.partitionBy(SHARD).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
