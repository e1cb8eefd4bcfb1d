"""Deletes and updates reach the table on disk, in one shard alone."""

from opsframe.sources import shards as H
from pyspark.sql import functions as F

TEN = H.ShardMap((("a", 0, 9),))


def test_delete_and_update_are_written_back(spark, tmp_path):
    path = str(tmp_path / "sharded")
    H.write_sharded(spark.range(40).select("id", (F.col("id") % 20).alias("k"), F.lit("o").alias("s")), TEN, "k", path)
    other = sorted(p.name for p in (tmp_path / "sharded" / "_shard=3").iterdir())
    H.replace_shard(H.update_shard_rows(spark, TEN, "k", 7, path, F.col("id") > 10, {"s": F.lit("X")}), TEN, 7, path)
    assert {r.id for r in spark.read.parquet(path).where("s = 'X'").collect()} == {27}
    H.replace_shard(H.delete_shard_rows(spark, TEN, "k", 7, path, F.lit(True)), TEN, 7, path)
    left = spark.read.parquet(path)
    assert left.count() == 38 and {r.id for r in left.where("_shard = 7").collect()} == {17, 37}
    H.replace_shard(H.delete_shard_rows(spark, TEN, "k", 17, path, F.lit(True)), TEN, 17, path)
    assert spark.read.parquet(path).where("_shard = 7").isEmpty() and spark.read.parquet(path).count() == 36
    assert sorted(p.name for p in (tmp_path / "sharded" / "_shard=3").iterdir()) == other
