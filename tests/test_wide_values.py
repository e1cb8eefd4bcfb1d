import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsframe.catalog.streams import stream_of
from opsframe.functions.user import safe_map
from opsframe.operators.sessions import typed_command
from opsframe.plans.model import Model
from opsframe.plans.predicates import YEAR, typed_filter
from opsframe.sources.writes import cascade_delete, dependency_preview


def test_wrong_typed_results_fail_their_row_only(spark):
    df = spark.createDataFrame([(2**60 + 1, 1), (None, 2), (5, None)], "id bigint, n int")
    got = {r.n: r for r in safe_map(df, lambda r: r["id"] if r["n"] != 2 else "text", "bigint").collect()}
    assert (got[1].id, got[1].value, got[1].ok) == (2**60 + 1, 2**60 + 1, True)
    assert (got[2].id, got[2].value, got[2].ok) == (None, None, False) and got[2].error
    assert (got[None].value, got[None].ok) == (5, True)


def test_year_reaches_the_scan(spark, tables):
    rows = spark.read.parquet(f"{tables}/events.parquet").filter(typed_filter(F.col("ts"), YEAR, "2024"))
    plan = rows._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-01" in plan
    edges = spark.createDataFrame([(dt.datetime(2023, 12, 31, 23, 59),), (dt.datetime(2024, 1, 1),), (dt.datetime(2025, 1, 1),)], "ts timestamp_ntz")
    assert edges.filter(typed_filter(F.col("ts"), YEAR, 2024)).count() == 1


def test_a_self_referencing_table_is_followed_to_its_end(spark):
    rows = spark.createDataFrame([(1, 1)] + [(i, i - 1) for i in range(2, 8)] + [(9, 9)], "id long, above long")
    node = Model("node", rows, "id")
    node.link("parent", "above", node)
    keys = spark.createDataFrame([(3,)], "id long")
    assert [r.id for r in dependency_preview([node], node, keys).collect()] == [4, 5, 6, 7]
    assert sorted(r.id for r in cascade_delete([node], node, keys)["node"].collect()) == [1, 2, 9]


def test_commands_are_whole_unless_asked(spark):
    df = spark.range(1).select(F.lit("u@h $ " + "x" * 500).alias("t"))
    assert df.select(F.length(typed_command(F.col("t")))).first()[0] == 500
    assert df.select(F.length(typed_command(F.col("t"), 200))).first()[0] == 200


def test_a_folder_table_streams(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream_of(spark, str(tmp_path), "events").writeStream.format("parquet").option("checkpointLocation", mark).trigger(
        availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 10


def test_response_times_of_many_values_are_selected_exactly(spark, monkeypatch):
    import statistics

    from opsframe.operators import aggregates as A

    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) + F.when(F.col("id") % 7 == 0, 5).otherwise(0)).alias("us"))
    rows = rows.unionByName(spark.range(30).select(F.lit(None).cast("long").alias("k"), (F.col("id") % 4).alias("us")))
    rows = rows.unionByName(spark.range(20_000).select(F.lit(9).cast("long").alias("k"), F.when(F.col("id") % 5 != 0, F.lit(7)).otherwise(F.col("id")).alias("us")))
    rows = rows.unionByName(spark.range(5).select(F.lit(9).cast("long").alias("k"), F.lit(None).cast("long").alias("us")))
    sizes = []
    real = A.materialised
    monkeypatch.setattr(A, "materialised", lambda df: (kept := real(df), sizes.append(kept.count()))[0])
    got = {r.k: r for r in A.response_times(rows, ["k"], "us").collect()}
    assert sizes[1] < 60_000 * 0.05 + 4 + 20_000 * 0.2  # the values inside the brackets, not all that differ
    for k, r in got.items():
        v = sorted(x.us for x in rows.where(F.col("k").eqNullSafe(k) & F.col("us").isNotNull()).collect())
        assert (r["count"], r.min, r.max, r.med) == (len(v), v[0], v[-1], statistics.median(v))
        for tag, some in (("", v), ("95", v[:len(v) * 95 // 100]), ("99", v[:len(v) * 99 // 100])):
            assert r[f"avg{tag}"] == pytest.approx(statistics.fmean(some)) and r[f"max{tag}"] == some[-1]
            assert r[f"std{tag}"] == pytest.approx(statistics.pstdev(some), rel=1e-6)
