"""Insert-or-ignore on streams: one id in several batches, batches that are run again, facts as they arrive."""

import datetime as dt
import json

from opsframe.streaming import ingest as I
from opsframe.streaming import keyed as K

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id string, ts timestamp_ntz, seq int, note string"
KEYS, ORDER = ["id"], ["ts", "seq"]


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Arrivals:
    def __init__(self, spark, folder, schema, start):
        self.spark, self.folder, self.schema, self.start, self.n = spark, folder, schema, start, 0
        self.store, self.check = str(folder / "store"), str(folder / "check")

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.folder}/in/part={self.n}")
        self.n += 1
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in/part=*")
        self.query = self.start(stream, self.store, self.check)
        self.query.awaitTermination()


def start(stream, store, check):
    return I.ingest(I.first_writers(stream, KEYS, ORDER, "10 minutes", "5 minutes"), store, KEYS, ORDER, check)


def test_the_first_by_event_time_is_stored_once(spark, tmp_path):
    run = Arrivals(spark, tmp_path, SCHEMA, start)
    schema = spark.createDataFrame([], SCHEMA).schema
    spark.createDataFrame([("old", at(-999), 0, "before")], SCHEMA).write.parquet(f"{run.store}/batch=-1")
    stored = lambda: sorted((str(r.id), r.note) for r in I.read_store(spark, run.store, schema).collect())
    run([("a", at(3), 1, "second"), ("old", at(1), 2, "again"), (None, at(1), 3, "n1"), (None, at(1), 3, "n1")])
    assert stored() == [("None", "n1"), ("None", "n1"), ("old", "before")]
    run([("a", at(1), 4, "first"), ("a", at(3), 1, "second"), ("b", at(4), 5, "b")])  # earlier, but later here
    run([("a", at(6), 6, "third"), ("c", at(40), 7, "c")])
    want = [("None", "n1"), ("None", "n1"), ("a", "first"), ("b", "b"), ("old", "before")]
    assert stored() == want
    run([("a", at(60), 8, "much later"), ("b", at(61), 9, "much later"), ("d", at(200), 10, "d")])
    assert stored() == sorted([*want, ("c", "c")])
    assert K.state_rows(run.query) <= 2  # the open session of d; not the five ids that were stored


def test_a_batch_that_is_run_again_leaves_the_same_rows(spark, tmp_path):
    stored = spark.createDataFrame([], SCHEMA)
    batch = [("x", at(1), 1, "x"), ("x", at(0), 2, "x first"), ("y", at(1), 3, "y")]
    store = str(tmp_path / "store")
    for _ in range(2):  # as a failed batch would be
        rows = I.new_rows(spark.createDataFrame(batch, SCHEMA), I.read_store(spark, store, stored.schema, before=7), KEYS, ORDER)
        rows.write.mode("overwrite").parquet(f"{store}/batch=7")
    assert sorted(r.note for r in I.read_store(spark, store, stored.schema).collect()) == ["x first", "y"]
    assert I.read_store(spark, store, stored.schema, before=7).count() == 0


def test_facts_are_stored_once_per_machine(spark, tmp_path):
    def line(host, uuid):
        return f"{host} => " + json.dumps({"ansible_facts": {"ansible_hostname": host, "ansible_product_uuid": uuid}})

    run = Arrivals(spark, tmp_path, "ts timestamp_ntz, no int, line string",
                   lambda s, store, check: I.ingest_facts(s, "line", "ts", store, "10 minutes", "1 minute", checkpoint=check))
    run([(at(2), 1, line("web1", "u1")), (at(1), 2, line("web0", "u1")), (at(2), 3, "no facts => {}")])
    run([(at(30), 4, line("web9", "u1")), (at(31), 5, line("db1", "u2"))])
    run([(at(90), 6, line("db7", "u2")), (at(91), 7, line("late", "u3"))])
    run([(at(300), 8, line("end", "u4"))])
    rows = spark.read.parquet(run.store).collect()
    assert sorted((r.product_uuid, r.hostname, r.last_update) for r in rows) == [("u1", "web0", at(1)), ("u2", "db1", at(31)), ("u3", "late", at(91))]
