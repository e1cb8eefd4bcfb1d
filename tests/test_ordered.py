from pyspark.sql import Window
from pyspark.sql import functions as F

from opsframe.plans.ordered import Timeline, number_rows


def rows(df):
    return sorted(df.collect(), key=str)


def test_chunked_scan_equals_plain_window(spark, tables):
    events = spark.read.parquet(f"{tables}/events.parquet").withColumn(
        "host", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_id") % 4))
    value = F.when(F.col("event_id") % 5 != 0, F.floor("value"))
    w = Window.partitionBy("host").orderBy("ts", "event_id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = events.select("host", "event_id", F.lag(value).over(w).alias("prev"), F.sum(value).over(upto).alias("total"),
                         F.last(value, ignorenulls=True).over(upto).alias("seen"))
    for limit in (7, 50, 10**9):
        line = Timeline(events, ["host"], ["ts", "event_id"], rows_per_task=limit)
        assert (line._rows.select("_chunk").distinct().count() > 4) == (limit < 10**9)
        got = line.scan(previous={"prev": value}, running={"total": value}, known={"seen": value}).frame
        assert rows(got.select(*want.columns)) == rows(want)


def largest(df, order):
    return Timeline(df, ["k"], order, rows_per_task=50)._rows.groupBy("_chunk").count().agg(F.max("count")).first()[0]


def test_any_shape_of_a_large_key_is_cut(spark):
    ids = spark.range(1000).withColumn("k", F.lit(None).cast("int"))
    burst = F.when(F.col("id") < 900, F.col("id")).otherwise(F.col("id") * 1_000_000)
    nested = F.when(F.col("id") < 990, F.col("id")).when(F.col("id") < 999, F.col("id") * 1_000).otherwise(10**15)
    for t in (burst, nested, F.lit(7)):
        assert largest(ids.withColumn("t", t), ["t", "id"]) <= 50


def test_scan_over_equal_times(spark):
    df = spark.range(200).select(F.lit("a").alias("k"), F.lit(0).alias("t"), "id")
    got = Timeline(df, ["k"], ["t", "id"], rows_per_task=9).scan(previous={"p": F.col("id")}, running={"r": F.lit(1)}).frame
    assert sorted((r.id, r.p, r.r) for r in got.collect()) == [(i, i - 1 if i else None, i + 1) for i in range(200)]
    assert Timeline(df.limit(0), ["k"], ["t", "id"]).scan(running={"r": F.lit(1)}).frame.count() == 0


def test_number_rows(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("x"))
    got = number_rows(df, [F.col("x").desc()], "n", start=5).collect()
    assert sorted((r.n, r.x) for r in got) == [(5 + i, 999 - i) for i in range(1000)]
