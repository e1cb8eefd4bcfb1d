"""Search through the index finds what a scan finds, among few candidates."""

import random

from opsframe.operators.search import TrigramIndex
from opsframe.plans import predicates as P


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcÄé%_1.") for _ in range(r.randint(0, 9)))
    rows = [(word() if r.random() > 0.1 else None, word(), r.randrange(1000, 9999)) for _ in range(400)] + [("Alpha", "x", 1), ("alphabet", "ALPHA", 2)]
    rows += [("dup", "same row", 5)] * 2
    df = spark.createDataFrame(rows, "name string, place string, no int").repartition(3)
    index = TrigramIndex.build(df, str(tmp_path / "index"), "name", ["place", "no"])
    texts = ["", "a", "%_", "alpha", "ALPHA", "lph", "dup", "99", "123", "nothing at all", "Äé%", "same ROW", rows[7][1][:4], rows[9][1]]
    for text in texts:
        found = index.search(text)
        assert found.columns == df.columns
        assert sorted(map(str, found.collect())) == sorted(map(str, P.search(df, text, "name", ["place", "no"]).collect())), text
    again = TrigramIndex(spark, index.path, df.schema, "name", ["place", "no"])
    assert sorted(again.search("alpha").collect()) == [("Alpha", "x", 1)]


def test_few_rows_are_read(spark, tables, tmp_path):
    customer = spark.read.parquet(f"{tables}/customer.parquet").select("c_name", "c_mktsegment")
    index = TrigramIndex.build(customer, str(tmp_path / "index"), "c_name", ["c_mktsegment"])
    want = customer.where("c_name LIKE '%0012%'").count()
    assert want <= index.candidates("0012").count() < customer.count() / 3
    assert index.candidates("zzz1").count() == 0
    plan = index._of("postings", ["mac"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_folder" in plan.replace("isnotnull(_folder", "_folder") and "PushedFilters" in plan


def test_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "name string, place string")
    index = TrigramIndex.build(df, str(tmp_path / "index"), "name", ["place"])
    assert index.search("abc").count() == index.search("").count() == 0
