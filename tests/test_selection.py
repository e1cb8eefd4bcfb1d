import datetime as dt

import pytest
from pyspark.sql import functions as F

from opsframe.catalog import QUERIES
from opsframe.catalog.base import Shop
from opsframe.operators import aggregates as A
from opsframe.operators import joins as J
from opsframe.operators import paging
from opsframe.plans import predicates as P
from opsframe.plans.model import field_tree, models_on_path


def ids(df, name="id"):
    return [r[name] for r in df.collect()]


def test_pages(spark):
    df = spark.range(45)
    assert ids(paging.page(df, "-id", "id", "0", None, 20)) == ids(paging.page(df, "-id", "id", "x", "99", 20)) == list(range(44, 24, -1))
    assert ids(paging.page(df, [], "id", "3", 20)) == [40, 41, 42, 43, 44]
    assert ids(paging.page(df, [], "id", "9")) == []
    assert ids(paging.deep_slice(df, ["-id"], 40, 10)) == [4, 3, 2, 1, 0]
    info = paging.page_info(df, "m", "3").first()
    assert (info.page, info.previous, info.next, info.pages, info.rows) == (3, 2, None, 3, 45)
    assert [paging.page_size(v, 20) for v in ("5", "500", "many", None)] == [5, 20, 20, 20]


def test_one_row(spark):
    assert P.only_row(spark.range(0)) is None
    assert P.only_row(spark.range(1)).id == 0
    with pytest.raises(ValueError):
        P.only_row(spark.range(2))


def test_values(spark):
    df = spark.range(5)
    assert ids(df.filter(P.value_in(F.col("id"), []))) == []
    assert ids(df.filter(P.value_in(F.col("id"), [1, 2, 9]))) == [1, 2]
    assert ids(P.where(df, 3)) == [3]
    assert ids(P.where(df, {"id": [1, 4]})) == [1, 4]
    assert ids(P.where(df, "id > $low AND id <> $not", {"low": 1, "not": 3})) == [2, 4]
    assert len(ids(P.where(df, {}))) == 5


def test_filters(spark):
    df = spark.createDataFrame([("a%b", dt.date(2024, 1, 5)), ("AXB", dt.date(2024, 1, 9))], "t string, d date")
    today = dt.date(2024, 1, 10)
    assert ids(df.filter(P.typed_filter(F.col("t"), P.STARTS, "A%")), "t") == ["a%b"]
    assert ids(df.filter(P.typed_filter(F.col("t"), P.CONTAINS, "a%b")), "t") == ["a%b", "AXB"]
    assert ids(df.filter(P.typed_filter(F.col("d"), P.WITHIN, 1, today)), "t") == ["AXB"]
    assert ids(df.filter(P.typed_filter(F.col("d"), P.OLDER, 1, today)), "t") == ["a%b"]


def test_lookups_parse():
    got = P.parse_lookups({"a__b__gt": "3", "-c": ["x", "y"], "d__nosuch": "1", "e__in": "1, 2"})
    assert got == {"a__b": [("gt", ["3"], False)], "c": [("eq", ["x", "y"], True)], "d__nosuch": [("eq", ["1"], False)],
                   "e": [("in", ["1", "2"], False)]}


def test_tree(spark, tables):
    shop = Shop(spark, tables)
    assert "customer__nation__region__r_name" in field_tree(shop.orders).paths()
    assert field_tree(shop.orders, ["o_orderkey", "customer__c_name"]).paths() == ["o_orderkey", "customer__c_name"]
    assert [m.name for m in models_on_path(shop.orders, "customer__nation")] == ["customer", "nation"]
    with pytest.raises(AttributeError):
        models_on_path(shop.orders, "nothing")


def test_sequences(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([9, 0, 2, 1, 0])], "i int, v int")
    assert ids(A.unique_by(df, F.col("v"), ["i"]).orderBy("i"), "v") == [9, 0, 2, 1]
    packs = A.batches(spark.range(1, 6), ["id"], 2, ["id"]).orderBy("batch").collect()
    assert [[x.id for x in p["items"]] for p in packs] == [[1, 2], [3, 4], [5]]
    counts = A.frequencies(spark.createDataFrame([("x",)] * 3 + [("y",)], "k string"), "k")
    assert {r.k: (r.n, r.share) for r in counts.collect()} == {"x": (3, 0.75), "y": (1, 0.25)}
    assert ids(A.extreme(counts), "k") == ["x"]
    maps = spark.createDataFrame([(1, 4), (3, 4)], "k int, v int")
    assert ids(A.keys_of(maps, "k", "v", 4), "k") == [1, 3] and ids(A.keys_of(maps, "k", "v", 5), "k") == []
    a, b = (spark.createDataFrame(rows, "k int, v int") for rows in ([(1, 0), (2, 0)], [(2, 1), (3, 1)]))
    assert sorted(map(tuple, A.merge_tables([a, b], ["k"], ["v"]).collect())) == [(1, 0), (2, 1), (3, 1)]


def test_addresses(spark):
    rows = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("300.1.1.1",), ("text",), ("11.0.0.1",)], "ip string")
    nets = spark.createDataFrame([("10.1.0.0", "255.255.0.0"), ("10.1.2.0", "255.255.255.0")], "net string, mask string")
    got = {r.ip: r.net for r in J.segment_of(rows, "ip", nets, "net", "mask").collect()}
    assert got == {"10.1.2.3": "10.1.2.0", "10.1.9.9": "10.1.0.0", "300.1.1.1": None, "text": None, "11.0.0.1": None}
    assert spark.range(1).select(J.int_to_ip(J.ip_to_int(F.lit("192.168.0.255")))).first()[0] == "192.168.0.255"


def test_response_times_small(spark):
    df = spark.createDataFrame([(1, v) for v in range(1, 101)], "k int, v long")
    r = A.response_times(df, ["k"], "v", rows_per_task=10).first()
    assert (r["count"], r["max"], r["min"], r.avg, r.med, r.max95, r.avg95, r.max99) == (100, 100, 1, 50.5, 50.5, 95, 48.0, 99)


@pytest.mark.parametrize("name", ["w1_counter_rates", "w9_event_gaps", "w11_audit_summary", "j10_learned_port"])
def test_hot_keys_change_nothing(spark, tables, name):
    want = sorted(map(str, QUERIES[name](spark, tables).collect()))
    spark.conf.set("opsframe.rowsPerTask", "15")
    try:
        assert sorted(map(str, QUERIES[name](spark, tables).collect())) == want
    finally:
        spark.conf.unset("opsframe.rowsPerTask")
