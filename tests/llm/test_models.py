"""Near duplicates against plain Python; classifiers by held-out accuracy; the pipeline."""

from collections import Counter

import __spark_entry__ as entry_point
import corpus_pipeline
import numpy as np
import pytest
from llm import brute
from opsframe.llm import near, quality, toxicity


def shingles(text):
    w = brute.LETTERS.findall((text or "").translate(brute.LOWER))
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(x, y):
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x[e] / x[d], y[e] / y[d]) for e in every) for d in x.keys() & y.keys())


def test_similarity_of_weighted_sets():
    r = np.random.default_rng(3)
    for _ in range(30):
        x, y = (Counter(r.integers(0, 12, r.integers(1, 40)).tolist()) for _ in range(2))
        pair = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float)) for c in (x, y)]
        assert near.similarity(*pair) == pytest.approx(jaccard(x, y))


def test_signature_estimates_similarity():
    r = np.random.default_rng(4)
    x = {int(k): int(w) for k, w in zip(r.integers(1, 2**60, 300), r.integers(1, 9, 300))}
    y = dict(list(x.items())[:240]) | {int(k): int(w) for k, w in zip(r.integers(1, 2**60, 60), r.integers(1, 9, 60))}
    values = np.array([k for c in (x, y) for k, w in c.items() for _ in range(w)], np.uint64)
    doc = np.repeat([0, 1], [sum(x.values()), sum(y.values())])
    sign = near.prob_min_hash(values, doc, 2)
    assert (sign[0] == sign[1]).mean() == pytest.approx(jaccard(Counter(x), Counter(y)), abs=0.12)


def test_classes(docs, rows):
    words = [(i, shingles(t), t) for i, t in rows]
    root = {i: i for i, _ in rows}
    for i, a, t in words:
        for j, b, u in words:
            same = (t or "") == (u or "") if not a or not b else jaccard(a, b) >= 0.8
            if same and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    found = near.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in found} == root and len(found) == len(rows)
    left = near.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(root.values()))


def test_models_on_held_out_rows(shipped):
    d, labels = (shipped.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    for df, name, least in ((quality.quality(d, labels), "quality", 0.95), (toxicity.toxicity(d, labels), "toxic", 0.9)):
        out = df.collect()
        assert len(out) == d.count() and all(0 <= r.score <= 1 for r in out)
        held = [r.predicted == truth[r.doc_id][name] for r in out if r.held_out and r.doc_id in truth]
        assert len(held) > 20 and sum(held) / len(held) >= least


def test_toxic_marginals_agree_with_all_paths():
    r = np.random.default_rng(1)
    e, t, first = r.normal(size=7), r.normal(size=(2, 2)), np.array([0, 4, 4, 7])
    p, pairs = toxicity.marginals(e, first, t, True)
    total, want = np.zeros((2, 2)), np.zeros(7)
    for a, b in ((0, 4), (4, 7)):
        z, part, edge = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in np.ndindex(*[2] * (b - a)):
            w = np.exp(sum(e[a + i] * s for i, s in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:])))
            z += w
            part += w * np.array(path)
            for x, y in zip(path, path[1:]):
                edge[x, y] += w
        want[a:b] = part / z
        total += edge / z
    assert np.allclose(p, want) and np.allclose(pairs, total)


def test_models_on_odd_and_empty_tables(docs, none, shipped):
    labels = shipped.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality(docs, labels).collect()} == {0.5}
    assert {r.predicted for r in toxicity.toxicity(docs, labels).collect()} == {1}
    some = shipped.createDataFrame([(i, i % 2, i % 2) for i in range(20)] + [(3, None, None), (None, 1, 1)], labels.schema)
    assert quality.quality(docs, some).count() == toxicity.toxicity(docs, some).count() == docs.count()
    assert quality.good(docs, some).columns == docs.columns
    assert quality.quality(none, some).count() == toxicity.toxicity(none, some).count() == near.near_duplicates(none).count() == 0


def test_pipeline(shipped, tables):
    docs = shipped.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(shipped, docs, tables)
        assert got.schema.names == docs.schema.names
        docs = corpus_pipeline.saved(got, "test")
    packed = corpus_pipeline.STAGES[-1][1](shipped, docs, tables)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    names = entry_point.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
