"""Tailing growing files: appended, half written, cut, renamed and removed ones, over several runs of one checkpoint."""

import os
import random

import pytest
from pyspark.sql import functions as F

from opsframe.sources import logs, tail
from opsframe.streaming.logs import ship

RULES = [logs.TailRule(r"app\.log", "app", "error"), logs.TailRule("web", "web", "info")]


class Run:
    """One checkpoint and one folder; each call is a new run of the query."""

    def __init__(self, spark, folder, **options):
        self.spark, self.options = spark, options
        self.logs = folder / "logs"
        self.logs.mkdir()
        self.out, self.check = str(folder / "out"), str(folder / "check")

    def __call__(self):
        lines = logs.follow_lines(self.spark, str(self.logs), RULES, **self.options)
        query = lines.writeStream.format("json").option("path", self.out).option("checkpointLocation", self.check)
        query.trigger(availableNow=True).start().awaitTermination()
        rows = self.spark.read.schema("msg string, file string, at long, tag string").json(self.out).collect()
        return sorted(r.msg for r in rows)

    def write(self, name, text, mode="a"):
        with open(self.logs / name, mode, newline="") as f:
            f.write(text)


def test_appended_lines_come_once_and_half_lines_wait(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.write("app.log", "one\ntwo\r\nhal")
    run.write("other.log", "not tailed\n")
    assert run() == ["one", "two"]
    assert run() == ["one", "two"]
    run.write("app.log", "f\n\nthree\nfo")
    run.write("web1.log", "Äé\n")
    assert run() == ["", "half", "one", "three", "two", "Äé"]
    run.write("app.log", "ur\n")
    assert run() == ["", "four", "half", "one", "three", "two", "Äé"]


def test_rotated_cut_and_removed_files(spark, tmp_path):
    run = Run(spark, tmp_path)
    run.write("app.log", "a1\na2\n")
    assert run() == ["a1", "a2"]
    run.write("app.log", "a3 before the turn\n")
    os.rename(run.logs / "app.log", run.logs / "app.log.1")
    run.write("app.log", "b1 of a longer line than all before it\nb2\n")
    want = ["a1", "a2", "a3 before the turn", "b1 of a longer line than all before it", "b2"]
    assert run() == want
    os.rename(run.logs / "app.log.1", run.logs / "app.log.2")
    os.rename(run.logs / "app.log", run.logs / "app.log.1")
    run.write("app.log.1", "b3\n")
    want.append("b3")
    assert run() == want
    run.write("app.log", "c1\n")
    assert run() == [*want, "c1"]
    run.write("app.log", "d\n", "w")  # cut and written anew, shorter than before
    os.remove(run.logs / "app.log.2")
    assert run() == [*want, "c1", "d"]


def test_parts_of_any_size_give_the_same_lines(spark, tmp_path):
    r = random.Random(1)
    lines = ["x" * r.choice([0, 1, 5, 40]) + str(i) for i in range(300)]
    for size in (7, 1000):
        folder = tmp_path / str(size)
        folder.mkdir()
        run = Run(spark, folder, partBytes=size)
        run.write("app.log", "".join(x + "\n" for x in lines[:200]))
        assert run() == sorted(lines[:200])
        run.write("app.log", "".join(x + "\n" for x in lines[200:]))
        assert run() == sorted(lines)


def test_max_bytes_ends_at_line_ends(tmp_path):
    (tmp_path / "app.log").write_text("".join(f"line {i}\n" for i in range(100)) + "z" * 500 + "\nlast\n")
    reader = tail.TailReader({"path": str(tmp_path), "maxbytes": "64", "partbytes": "30"})
    found, before, batches = [], reader.initialOffset(), 0
    while (now := reader.latestOffset()) != before:
        batches += 1
        parts = reader.partitions(before, now)
        again = reader.partitions(before, now)
        assert [vars(p) for p in parts] == [vars(p) for p in again]
        found += [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
        before = now
    assert found == [f"line {i}" for i in range(100)] + ["z" * 500, "last"] and batches > 10


def test_a_file_renamed_between_planning_and_reading(tmp_path):
    (tmp_path / "app.log").write_text("one\ntwo\n")
    reader = tail.TailReader({"path": str(tmp_path)})
    parts = reader.partitions({}, reader.latestOffset())
    os.rename(tmp_path / "app.log", tmp_path / "app.log.1")
    (tmp_path / "app.log").write_text("new\n")
    assert [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()] == ["one", "two"]
    os.remove(tmp_path / "app.log.1")
    with pytest.raises(FileNotFoundError):
        list(reader.read(parts[0]))
    lenient = tail.TailReader({"path": str(tmp_path), "failonloss": "false"})
    assert list(lenient.read(parts[0])) == []


def test_routing_over_a_file_that_grows_between_two_triggers(spark, tmp_path):
    folder, out, check = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    for text in ("first\nsec", "ond\nthird\n", ""):
        with open(folder / "app.log", "a") as f:
            f.write(text)
        ship(spark, str(folder), RULES, {"urgent": "*.err", "all": "*.*"}, "h", out, check).awaitTermination()
    rows = spark.read.schema("value string, route string").text(out).groupBy("route").agg(F.sort_array(F.collect_list("value")).alias("v"))
    assert {r.route: r.v for r in rows.collect()} == {k: ["h app first", "h app second", "h app third"] for k in ("urgent", "all")}
