"""Keyed streams hand many keys over at once: state calls don't grow with the keys, and keys of a bucket stay apart."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from opsframe.streaming import keyed as K
from streams import Runs

T0 = dt.datetime(2024, 1, 1)


class Handle:
    """Stands in for a bucket's state and counts the calls."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.calls += 1
        self.rows = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_do_not_grow_with_the_keys():
    handle, n = Handle(), 3000
    rates = K.Rates(1, 1.0, ["int"], ["x_v0 long", "x_z0 boolean"], 60.0, "")
    rates.init(handle)
    at = np.repeat(np.arange(2) * 1_000_000, n)
    rows = pd.DataFrame({"x_key": [f"k{i}" for i in range(n)] * 2, "x_at": at, "x_t0": 0, "x_row": [f"{i}" for i in range(2 * n)],
                         "x_v0": [i * i for i in range(2 * n)], "x_z0": False})
    found = pd.concat(rates.handleInputRows((0,), iter([rows.iloc[::2], rows.iloc[1::2]]), handle))
    assert handle.calls == 3 and len(handle.rows) == n
    want = {str(i): 0.0 for i in range(n)} | {str(n + i): float((n + i) ** 2 - i * i) for i in range(n)}
    assert dict(zip(found["x_row"], found["x_r0"])) == want
    more = pd.DataFrame({"x_key": ["k1", "k1", "k2"], "x_at": [0, 9_000_000, 1_000_000], "x_t0": [5, 0, 1], "x_row": ["a", "b", "c"], "x_v0": [0, 1, 2], "x_z0": False})
    found = pd.concat(rates.handleInputRows((0,), iter([more]), handle))
    assert sorted(zip(found["x_row"], found["late"])) == [("a", True), ("b", False), ("c", False)]
    handle.now = handle.timers[-1]  # the keys that end first go; the one with a newer row stays
    assert list(rates.handleExpiredTimer((0,), handle, None)) == []
    assert [r[0] for r in handle.rows] == ["k1"] and handle.timers[-1] == 9_000 + 1 + 60_000


def test_keys_of_one_bucket_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "BUCKETS", 1)
    at = lambda **d: T0 + dt.timedelta(**d)
    schema = "a long, b string, ts timestamp_ntz, seq int, what string"
    big = 2**62 + 1
    run = Runs(spark, tmp_path, schema, lambda s: K.login_sessions(
        s, ["a", "b"], ["ts", "seq"], F.col("what") == "logout", gap=3600.0, late_by="1 minute"))
    keys = [(big, "x"), (big + 1, "x"), (None, "x"), (big, None), (None, None), (big, 'q"{')]
    got = run([(*k, at(minutes=i), i, "login") for i, k in enumerate(keys)])
    assert {((r.a, r.b), r.start_time, r.n) for r in got} == {(k, at(minutes=i), 1) for i, k in enumerate(keys)}
    got = run([(*keys[0], at(minutes=20), 9, "logout"), (*keys[4], at(minutes=21), 8, "login")])
    assert {((r.a, r.b), r.start_time, r.is_finished, r.n) for r in got} == {(keys[0], at(), True, 2), (keys[4], at(minutes=4), False, 2)}
    run([(7, "new", at(hours=9), 10, "login")])
    assert K.state_rows(run.query) <= 3  # the silent keys went, one by one's own time
    got = run([(*keys[4], at(hours=9, minutes=1), 11, "login")])
    assert [((r.a, r.b), r.start_time, r.n) for r in got] == [(keys[4], at(hours=9, minutes=1), 1)]
