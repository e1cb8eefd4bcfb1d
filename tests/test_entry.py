import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_point

ROOT = Path(__file__).resolve().parents[1]


def test_entry_gives_nested_rows(spark):
    df = entry_point.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 20
    assert all(r.o_custkey.c_nationkey.n_name == "NATION_7" and r.o_totalprice > 100000 for r in rows)
    assert [r.o_totalprice for r in rows] == sorted((r.o_totalprice for r in rows), reverse=True)


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_named_checkpoint_folder_is_used(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.sql.shuffle.partitions", "2").getOrCreate()
from opsframe.plans.ordered import number_rows
assert number_rows(spark.range(5), ["id"], "n").count() == 5
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    assert any(p.is_file() for p in tmp_path.rglob("part-*"))
