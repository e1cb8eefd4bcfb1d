"""SQL text in selections, null groups and keys, ties, large doubles, ordinary statements."""

from pyspark.sql import functions as F

from opsframe.functions.report import commas
from opsframe.functions.text import classify_statements
from opsframe.operators.aggregates import in_parts, response_times
from opsframe.operators.joins import snapshot_diff
from opsframe.operators.paging import deep_slice, slice_rows
from opsframe.plans.model import Model
from opsframe.plans.predicates import select, where
from opsframe.sources.inventory import export_json


def test_order_columns_and_braces_as_text(spark):
    df = spark.createDataFrame([(1, 5, "aa"), (2, 7, "b"), (3, 7, "{x}")], "id int, v int, s string")
    assert [r.id for r in select(df, order="v DESC, id").collect()] == [2, 3, 1]
    assert [r.id for r in select(df, order="v + 0 desc, coalesce(id, 1) desc", limit=2).collect()] == [3, 2]
    assert [r.x for r in select(df, "coalesce(nullif(v, 7), id, 1) AS x, ',' AS y", order="id").collect()] == [5, 2, 3]
    assert [r.id for r in where(df, "s rlike '^a{2}$' or s = '{x}'").collect()] == [1, 3]


def test_null_groups_and_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, v int")
    assert {(r.g, len(r["items"])) for r in in_parts(df, ["g"], ["v"], 5, ["v"]).collect()} == {(None, 2), ("a", 1)}
    assert {r.g for r in response_times(df, ["g"], "v").collect()} == {None, "a"}
    assert snapshot_diff(df.where("v <> 2"), df.where("v <> 2"), ["g"], ["v"]).count() == 0
    moved = snapshot_diff(df.where("v = 1"), df.where("v = 2"), ["g"], ["v"]).collect()
    assert [(r.g, r.change, r.old_v, r.new_v) for r in moved] == [(None, "move", 1, 2)]


def test_ties(spark):
    df = spark.range(10).select("id", F.lit(1).alias("v"))
    assert deep_slice(df, ["v"], 2, 3).count() == slice_rows(df, ["v"], 2, 3).count() == 3
    lines = [r.line for r in export_json(Model("t", df.where("id < 2"), "id"), ["id"], ["v"]).collect()]
    assert [x.startswith(",") for x in lines] == [False, False, True, False]


def test_commas_of_large_doubles(spark):
    df = spark.createDataFrame([(12345678.5,), (1234.25,), (1e7,), (-98765432.0,)], "v double")
    assert [r[0] for r in df.select(commas(F.col("v"))).collect()] == ["12,345,678.5", "1,234.25", "10,000,000.0", "-98,765,432.0"]


def test_ordinary_statements(spark):
    texts = ["select * from t", "SELECT a\nFROM t\nORDER BY a", "update t set a = 1", "delete from t", "insert into t(a) values (1)", "show tables"]
    rows = classify_statements(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, q string"), "q").orderBy("i").collect()
    assert [(r.kind, r.table, r.reads, r.target) for r in rows] == [
        ("select", "t", True, "read"), ("select", "t", True, "read"), ("update", "t", False, "write"), ("delete", "t", False, "write"),
        ("insert", "t", False, "write"), (None, None, None, "write")]
