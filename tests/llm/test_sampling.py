"""An id with many texts is one document of the sample."""

from opsframe.llm import sampling


def test_one_text_of_an_id_is_sampled(shipped):
    rows = [(i, f"text {i}") for i in range(20)] + [(1, f"other {i}") for i in range(200)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = shipped.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    texts, given, share = sampling.labelled(docs, labels, "label", (20, 20), 100)
    kept = [i for i in range(20) if not docs.where(f"doc_id = {i}").where(sampling.held_out(docs["doc_id"])).count()]
    assert len(texts) == len(kept) and 1 in kept
    assert sum(given) == sum(i % 2 for i in kept) and share == sum(given) / len(kept)
