"""Different documents of one id stay apart, however many there are."""

import pytest
from opsframe.llm import contamination, lines, near, passages, store
from pyspark.sql import functions as F

N = 60_000


@pytest.fixture(scope="module")
def alike(shipped):
    """Two texts with a null id whose 64-bit hashes agree in the 27 leading bits."""
    text = F.concat_ws(" ", *[F.sha1(F.concat_ws("-", "id", F.lit(i))) for i in range(3)])
    every = shipped.range(N).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))
    lead = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 64 - 27)
    pair = every.groupBy(lead).agg(F.sort_array(F.collect_list("text")).alias("t")).where("size(t) = 2").orderBy("t").first().t
    return every, pair


def test_no_two_documents_share_a_key(alike):
    every, _ = alike
    assert store.keyed(every).select(*store.KEY).distinct().count() == N
    assert store.wrapped(every.where("text > 'f'")).join(store.keyed(every), store.KEY, "left_anti").isEmpty()


@pytest.mark.parametrize("doc_id", [None, 7])
def test_results_of_documents_of_one_id(shipped, alike, doc_id):
    one, two = alike[1]
    body = " ".join(f"w{i}" for i in range(40))
    # for the id 7 the two texts needn't agree in any bit; the results are the same
    rows = [(doc_id, one), (doc_id, two), (1, f"{body} tail"), (2, f"{body} end")] + [(i, f"foot\n{i}") for i in range(10, 20)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    bench = shipped.createDataFrame([(1, one.split()[0])], "item_id long, text string")
    hit = sorted((r.n_words, r.n_hit) for r in contamination.contamination(docs, bench).where(F.col("doc_id").eqNullSafe(doc_id)).collect())
    assert hit == [(3, 0), (3, 1)]
    assert {r.text for r in contamination.clean(docs, bench).collect()} == {t for _, t in rows} - {one}
    left = {r.text for r in near.one_of_each(docs).collect()}
    assert {one, two} <= left
    kept = {r.kept for r in lines.line_dedup(docs).collect()}
    assert {one, two} <= kept
    assert sorted(r.n_removed for r in passages.without_passages(docs).collect()) == [0] * 12 + [40, 40]


def test_classes_of_null_repeated_and_text_ids_stay_apart(shipped):
    rows = [(None, "a"), (None, "b"), (0, "c"), (0, "d"), (5, "b"), (5, "b")]
    found = near.near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.class_key for r in found}) == 4 and sorted(r.class_size for r in found) == [1, 1, 1, 3, 3, 3]
    docs = shipped.createDataFrame([("x1", "one two three"), ("x2", "One, two three!"), (None, "other"), ("x10", "alone")], "doc_id string, text string")
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in near.near_duplicates(docs).collect()) == [
        ("None", "", 1), ("x1", "x1", 2), ("x10", "x10", 1), ("x2", "x1", 2)]
    assert sorted(str(r.doc_id) for r in near.one_of_each(docs).collect()) == ["None", "x1", "x10"]
