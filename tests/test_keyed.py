"""Streams with keyed state over several batches: late rows, state that goes, sessions over midnight, link take-downs."""

import datetime as dt

from pyspark.sql import functions as F

from opsframe.streaming import keyed as K
from opsframe.streaming import operators as T
from opsframe.streaming.updates import newest_updates
from streams import Runs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "host string, ts timestamp_ntz, seq int, counter long"


def at(**delta):
    return T0 + dt.timedelta(**delta)


def test_late_rows_come_out_marked_or_are_counted(spark, tmp_path):
    run = Runs(spark, tmp_path, SCHEMA, lambda s: K.streaming_rates(s, ["host"], ["ts", "seq"], ["counter"], late_by="10 minutes"))
    got = run([("a", at(minutes=30), 1, 5), (None, at(minutes=31), 2, 7), ("a", at(minutes=29), 0, 3)])
    assert sorted((r.seq, r.counter_rate, r.late) for r in got) == [(0, 0.0, False), (1, 2.0, False), (2, 0.0, False)]
    got = run([("a", at(minutes=25), 3, 9), ("a", at(minutes=30), 1, 9), ("a", at(minutes=40), 4, None), ("a", at(minutes=5), 5, 9)])
    assert sorted((r.seq, r.counter_rate, r.late) for r in got) == [(1, None, True), (3, None, True), (4, None, False)]
    assert K.behind_watermark(run.query) == 1
    assert [(r.seq, r.counter_rate) for r in run([(None, at(minutes=41), 6, 10)])] == [(6, 3.0)]


def test_state_stays_bounded_over_many_batches(spark, tmp_path):
    run = Runs(spark, tmp_path, SCHEMA, lambda s: K.streaming_rates(s, ["host"], ["ts", "seq"], ["counter"], late_by="1 minute", keep=600.0))
    sizes = []
    for i in range(6):  # four hosts of a batch never come again
        run([(f"{i}-{j}", at(minutes=20 * i + j), j, 1) for j in range(4)])
        sizes.append(K.state_rows(run.query))
    assert max(sizes[1:]) <= 8 and sizes[-1] <= 8
    assert [r.counter_rate for r in run([("0-0", at(hours=5), 9, 100)])] == [0.0]  # forgotten: a first sample again


def test_a_moved_address_is_told_once(spark, tmp_path):
    run = Runs(spark, tmp_path, "mac int, ts timestamp, seq int, port string", lambda s: K.streaming_locations(s, ["mac"], ["ts", "seq"], ["port"]))
    assert [(r.seq, r.old_port) for r in run([(1, at(seconds=1), 1, "p"), (1, at(seconds=2), 2, "p")])] == [(1, None)]
    got = run([(1, at(seconds=3), 3, "p"), (1, at(seconds=4), 4, "q"), (1, at(seconds=5), 5, None), (1, at(seconds=6), 6, None)])
    assert sorted((r.seq, r.old_port) for r in got) == [(4, "p"), (5, "q")]


def test_sessions_last_from_login_to_logout(spark, tmp_path):
    schema = "who string, ts timestamp_ntz, seq int, what string"
    run = Runs(spark, tmp_path, schema, lambda s: K.login_sessions(s, ["who"], ["ts", "seq"], F.col("what") == "logout", gap=3600.0, late_by="1 minute"))
    run([("a", at(hours=23, minutes=59), 1, "login"), ("b", at(hours=23, minutes=58), 2, "login")])
    run([("a", at(hours=24, minutes=5), 3, "logout")])
    run([("a", at(hours=24, minutes=6), 4, "login"), ("b", at(hours=25, minutes=30), 5, "logout"), ("a", at(hours=24, minutes=2), 6, "late")])
    late = [r.who for r in spark.read.parquet(str(tmp_path / "out")).where("late").collect()]
    found = newest_updates(spark, str(tmp_path / "out"), ["who", "start_time"]).where("NOT late").collect()
    want = [("a", at(hours=23, minutes=59), at(hours=24, minutes=5), True, 2), ("a", at(hours=24, minutes=6), None, False, 1),
            ("b", at(hours=23, minutes=58), None, False, 1), ("b", at(hours=25, minutes=30), at(hours=25, minutes=30), True, 1)]
    assert sorted((r.who, r.start_time, r.end_time, r.is_finished, r.n) for r in found) == sorted(want, key=lambda w: w[:2])
    assert late == [] and K.behind_watermark(run.query) == 1 or late == ["a"]


def test_ports_take_their_links_down_unless_added_again(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string, port int, src_port int, dst_port int"

    def build(rows):
        return T.link_takedowns(rows.where("src_port IS NOT NULL").select("ts", "src_port", "dst_port"), rows.where("port IS NOT NULL"),
                                ["port"], "ts", "1 hour", "5 minutes", "1 minute")

    run = Runs(spark, tmp_path, schema, build)
    sight = lambda m, a, b: (at(minutes=m), None, None, a, b)
    port = lambda m, kind, p: (at(minutes=m), kind, p, None, None)
    none = run([sight(0, 1, 2), sight(1, 1, 2), sight(2, 3, 4), sight(3, 2, 5), port(10, "delete", 1), port(11, "delete", 4)])
    assert none == []  # an add could still come
    none = run([port(12, "add", 4), sight(13, 8, 9)])
    assert none == []
    got = run([sight(20, 8, 9), port(20, "modify", 8)])
    assert [(r.src_port, r.dst_port, r.ts, r.event) for r in got] == [(1, 2, at(minutes=10), "delete")]
    got = run([port(90, "delete", 2), port(100, "modify", 1)])  # the sightings of port 2 are over an hour old
    got += run([port(101, "modify", 1)])
    assert got == []
