"""Take-downs of links: as many rows of state as ports, links and hours, not as sightings; ranges with their ends."""

import datetime as dt
import random

from opsframe.streaming import keyed as K
from opsframe.streaming import operators as T
from streams import Runs

T0 = dt.datetime(2024, 1, 1)
H, G = dt.timedelta(hours=1), dt.timedelta(minutes=10)


def test_state_does_not_grow_with_sightings_and_ranges_are_exact(spark, tmp_path):
    def build(rows):
        return T.link_takedowns(rows.select("ts", "src_port", "dst_port"), rows, ["port"], "ts", "1 hour", "10 minutes", "1 minute")

    run = Runs(spark, tmp_path, "ts timestamp_ntz, kind string, port int, src_port int, dst_port int", build)
    r = random.Random(1)
    rows = [(T0 + dt.timedelta(minutes=r.randrange(300)), r.choice(["modify"] * 30 + ["delete", "add"]), r.randrange(4),
             r.choice([None, 0, 1, 2, 3]), r.randrange(7)) for _ in range(1500)]
    got = run(rows)
    assert K.state_rows(run.query) < 300  # of 1,500 rows, about 300 in the last hour, each with two ends
    got += run([(T0 + dt.timedelta(hours=9), "modify", 9, 9, 9)])
    links = {(src, dst) for *_, src, dst in rows}
    want = {(src, dst, t) for t, kind, p, *_ in rows if kind == "delete"
            and not any(k == "add" and q == p and t < a <= t + G for a, k, q, *_ in rows)
            for src, dst in links if p in (src, dst) and any((s, d) == (src, dst) and t - H <= a <= t for a, _, _, s, d in rows)}
    assert want and {(x.src_port, x.dst_port, x.ts) for x in got} == want
