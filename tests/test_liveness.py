import datetime as dt
import random

from pyspark.sql import functions as F

from opsframe.streaming import keyed as K
from opsframe.streaming import operators as T
from streams import Runs

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "src bigint, dst bigint, ts timestamp_ntz, seq bigint, kind string, n bigint"


def sample(seed, count=600):
    rnd, rows, now = random.Random(seed), [], 0.0
    for seq in range(count):
        now += rnd.choice([0.1, 0.3, 0.9, 2.0])
        a, b = rnd.choice([(1, 2), (2, 1), (1, 2), (2, 1), (3, 4), (4, 3), (5, 6)])
        kind = "seen" if rnd.random() < 0.12 else "probe"
        rows.append((a, b, T0 + dt.timedelta(seconds=round(now, 3)), seq, kind, 1))
    return rows


def model(rows, timeout=10.0, losses=5):
    """One row after the other, as a single machine would do it."""
    seen, sent, aged, out = {}, {}, set(), []
    for a, b, ts, seq, kind, _ in rows:
        link, back = (a, b), (b, a)
        if kind == "seen":
            if link not in seen:
                out.append((a, b, seq, "add"))
            seen[link], sent[link] = ts, 0
            aged.discard(link)
        else:
            sent[link] = sent.get(link, 0) + 1
            late = link in seen and (ts - seen[link]).total_seconds() > timeout
            if link in seen and sent[link] > losses and (late or link in aged):
                out.append((a, b, seq, "delete"))
                del seen[link]
                aged.discard(link)
                if back in seen:
                    aged.add(back)
    return sorted(out)


def found(df):
    return sorted((r.src, r.dst, r.seq, r.event) for r in df.collect())


def test_link_events_equal_the_model_with_and_without_chunks(spark):
    rows = sample(7)
    df = spark.createDataFrame(rows, SCHEMA)
    want = model(rows)
    assert len([w for w in want if w[3] == "delete"]) > 5
    for limit in (40, 10**6):
        assert found(T.link_events(df, rows_per_task=limit)) == want


def test_stream_in_several_batches_equals_the_model(spark, tmp_path):
    rows = sample(11, 400)
    folder = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(rows[i * 100:(i + 1) * 100], SCHEMA).coalesce(1).write.parquet(str(folder / f"part={i}"))
    out, check = (str(tmp_path / n) for n in ("out", "check"))
    for i in range(4):  # one folder more each time: the query resumes from its checkpoint
        stream = spark.readStream.schema(SCHEMA).parquet(str(folder / f"part=[0-{i}]"))
        K.run_batches(K.streaming_liveness(stream), out, check).awaitTermination()
    assert found(K.read_batches(spark, out)) == model(rows)


def test_late_sightings_do_not_revive_a_removed_link(spark, tmp_path):
    at = [T0 + dt.timedelta(seconds=i) for i in range(4000)]
    run = Runs(spark, tmp_path, SCHEMA, lambda s: K.streaming_liveness(s, late_by="1 hour", keep=1800.0))
    first = [(1, 2, at[0], 0, "seen", 1)] + [(1, 2, at[i], i, "probe", 1) for i in range(1, 20)]
    assert [r.event for r in sorted(run(first), key=lambda r: r.seq)] == ["add", "delete"]
    assert [(r.src, r.event, r.late) for r in run([(1, 2, at[5], 30, "seen", 1), (3, 4, at[39], 31, "probe", 1)])] == [(1, "late", True)]
    assert run([(5, 6, T0 + dt.timedelta(hours=3), 32, "probe", 1)]) == []
    assert K.state_rows(run.query) == 1  # pairs without a live link go after `keep`
    assert [(r.src, r.event) for r in run([(1, 2, T0 + dt.timedelta(hours=4), 33, "seen", 1)])] == [(1, "add")]
    assert run([(1, 2, at[7], 34, "seen", 1)]) == [] and K.behind_watermark(run.query) == 1


def test_a_silent_link_goes_without_a_row_and_ages_its_reverse(spark, tmp_path):
    run = Runs(spark, tmp_path, SCHEMA, lambda s: K.streaming_liveness(s, silence=5.4, late_by="1 second"))
    at = [T0 + dt.timedelta(seconds=i) for i in range(100)]
    assert [r.event for r in run([(1, 2, at[0], 0, "seen", 1), (2, 1, at[3], 1, "seen", 1), (7, 8, at[4], 2, "seen", 1)])] == ["add"] * 3
    assert run([(9, 9, at[9], 3, "probe", 1)]) == []  # the watermark stands at 8 s
    gone = run([(9, 9, at[13], 4, "probe", 1)])
    assert sorted((r.src, r.dst, r.ts, r.seq, r.event) for r in gone) == [(1, 2, at[10], None, "delete"), (2, 1, at[10], None, "delete")]
    assert run([(7, 8, at[13], 5, "seen", 1)]) == []
    later = run([(1, 2, at[20], 6, "seen", 1), (9, 9, at[60], 7, "probe", 1)])
    assert sorted((r.src, r.event, r.ts) for r in later) == [(1, "add", at[20]), (1, "delete", at[30]), (7, "delete", at[23])]


def test_snapshot(spark):
    rows = [(1, 2, T0, 0, "seen", 1), (2, 1, T0, 1, "seen", 1)] + [
        (1, 2, T0 + dt.timedelta(seconds=i), 1 + i, "probe", 1) for i in range(1, 8)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.src, r.dst): (r.unanswered, r.action) for r in
           T.expired_now(df, F.lit(T0 + dt.timedelta(seconds=11)).cast("timestamp_ntz")).collect()}
    assert got == {(1, 2): (7, "remove"), (2, 1): (0, "check")}
