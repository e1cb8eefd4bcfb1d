"""One document from many tasks, or none."""

import json
import os

import pytest
from pyspark.sql import functions as F

from opsframe.sources import inventory
from opsframe.sources.documents import JsonArray, OneText, write_document


def document(path):
    return "".join(open(os.path.join(path, f), newline="").read() for f in sorted(os.listdir(path)) if f[0] not in "._")


def test_parts_are_one_array_in_order(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 7).where("id % 143 <> 5 AND (id < 143 OR id > 300)")  # one partition is empty
    path = str(tmp_path / "a")
    write_document(rows.select(F.to_json(F.struct("id", F.lit("é\n,").alias("t")))), path, JsonArray)
    assert json.loads(document(path)) == [{"id": r.id, "t": "é\n,"} for r in rows.collect()]
    with pytest.raises(Exception, match="holds files already"):
        write_document(spark.range(1).select(F.lit("1")), path, JsonArray)
    assert len(json.loads(document(path))) == rows.count()
    write_document(spark.range(2).select(F.lit("{}")), path, JsonArray, overwrite=True)
    assert json.loads(document(path)) == [{}, {}]
    write_document(spark.range(0).select(F.lit("{}")), str(tmp_path / "none"), JsonArray)
    assert json.loads(document(str(tmp_path / "none"))) == []


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = tmp_path / "b"
    bad = spark.range(0, 100, 1, 5).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")))
    with pytest.raises(Exception):
        write_document(bad, str(path), JsonArray)
    assert not path.exists() or not [f for f in os.listdir(path) if f[0] != "_"]  # a task may outlive the job


def test_an_inventory_is_one_file(spark, tmp_path):
    groups = spark.createDataFrame([("b", "2.2.2.2"), ("a", "1.1.1.2"), ("a", "1.1.1.1")], "group string, host string")
    path = str(tmp_path / "ini")
    write_document(inventory.inventory_lines(groups).select("line"), path, OneText)
    assert document(path) == "[a]\n1.1.1.1\n1.1.1.2\n\n[b]\n2.2.2.2\n\n"
    with pytest.raises(Exception, match="one column"):
        write_document(groups, str(tmp_path / "two"), OneText)
