"""Rows that repeat one document stay bounded."""

from llm import brute
from opsframe.llm import passages, repeats, store


def test_repeats_of_a_row_do_not_travel_into_a_shard(shipped, monkeypatch):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(1, f"{body} tail")] * 40 + [(2, f"{body} end"), (3, "alone"), (None, body), (None, body), (4, None)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    real = passages.strip_shard

    def few(rows, places):
        assert len(rows) <= 5, f"{len(rows)} rows in a shard"
        return real(rows, places)

    monkeypatch.setattr(passages, "strip_shard", few)
    got = [tuple(r) for r in passages.without_passages(docs).collect()]
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(got, key=key) == sorted(brute.op10(rows), key=key)


def test_repeats_of_a_row_do_not_multiply_what_is_compared(shipped):
    body = " ".join(f"w{i}" for i in range(200))
    sizes = set()
    for m in (2, 10, 400):
        rows = [(1, f"{body} tail")] * m + [(2, f"{body} end of another"), (3, "alone")]
        docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
        one, again = store.one_row_each(store.keyed(docs))
        assert (one.count(), again.count()) == (3, 1)
        sizes.add((repeats.repeated_runs(store.keyed(docs), 400, 32).count(), passages.recurring(one, again, 35, 8).count()))
        if m == 10:
            assert sorted(tuple(r)[:5] for r in repeats.repeats(docs).collect()) == sorted(brute.op3(rows))
            assert sorted(tuple(r) for r in passages.without_passages(docs).collect()) == sorted(brute.op10(rows))
    assert len(sizes) == 1
