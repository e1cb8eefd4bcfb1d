"""Rows that grow into long lines are dealt over tasks by their number, whatever files they come in."""

from opsframe.catalog import storage


def test_rows_of_one_file_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_PER_TASK", 100)
    dealt = storage.spread(spark.range(1000).coalesce(1))
    assert dealt.rdd.getNumPartitions() == 11 and dealt.distinct().count() == 1000
