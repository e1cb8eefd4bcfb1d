"""Near duplicates against all pairs; families of one template; which pairs are compared."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from opsframe.llm import near


def bag_of(text):
    data = text.encode()
    values, _, _, _ = near.shingles(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return np.sort(values).tobytes()


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def changed(r, text, n):
    text = list(text)
    for i in r.sample(range(len(text)), n):
        text[i] = words(r, 1)[0]
    return text


@pytest.fixture(scope="module")
def family():
    """80 pages of one template with 35 % of their own, of which 20 have a close copy, and chains around the threshold."""
    r = random.Random(11)
    template = words(r, 130)
    pages = [template + words(r, 70) for _ in range(80)]
    pages += [changed(r, p, 2) for p in pages[:20]]
    chain = words(r, 200)
    for _ in range(12):
        pages.append(chain)
        chain = changed(r, chain, r.choice([2, 4, 5]))
    return [(i, " ".join(p)) for i, p in enumerate(pages)]


def brute(rows):
    bags = {i: near.weights(bag_of(t)) for i, t in rows}
    links = {(i, j) for i, j in combinations(sorted(bags), 2) if near.similarity(bags[i], bags[j]) >= near.LEAST}
    root = {i: i for i in bags}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        root[b] = a
    return links, {i: top(i) for i in bags}


def test_rarest_shingles_meet_wherever_documents_are_alike():
    r = np.random.default_rng(3)
    alike = 0
    for _ in range(400):
        pool = r.integers(0, 2**64, 60, dtype=np.uint64)
        often = r.integers(0, 4, 1 << near.SLOTS).astype(np.uint16)
        weight = r.integers(1, r.choice([2, 9]), 60)
        other = np.where(r.random(60) < r.choice([0.03, 0.1]), r.integers(0, 9, 60), weight)
        a, b = (np.sort(np.repeat(pool, w)).tobytes() for w in (weight, other))
        if near.similarity(near.weights(a), near.weights(b)) >= near.LEAST:
            alike += 1
            assert len(np.intersect1d(near.rare(a, often), near.rare(b, often)))
    assert alike > 100


def test_classes_equal_all_pairs(shipped, family):
    links, root = brute(family)
    found = {r.doc_id: r.class_id for r in near.near_duplicates(shipped.createDataFrame(family, "doc_id long, text string")).collect()}
    kept = sum(found[i] == found[j] for i, j in links)
    assert len(links) > 25 and kept >= 0.9 * len(links)
    assert all(root[i] == root[c] for i, c in found.items())  # nothing is linked that isn't alike


def test_pages_of_a_template_are_not_compared(shipped, family, monkeypatch):
    counts = []
    real = near.in_play

    def spy(opened):
        found = real(opened)
        counts.append((opened.count(), found.count()))
        return found

    monkeypatch.setattr(near, "in_play", spy)
    sizes = {r.class_size for r in near.near_duplicates(shipped.createDataFrame(family[:80], "doc_id long, text string")).collect()}
    (opened, playing), = counts
    assert sizes == {1} and opened > 60 and playing == 0


def test_only_pairs_that_share_a_bucket_are_compared(family, monkeypatch):
    compared = []
    real = near.weights
    monkeypatch.setattr(near, "weights", lambda bag: compared.append(bag) or real(bag))
    bag = bag_of(family[0][1])
    rows = [{"node": {"id": i}, "root": {"id": i}, "bands": [b] * near.BANDS, "bag": bag + bytes([i] * 8)} for i, b in ((1, 7), (2, 7), (3, 8))]
    schema = pa.schema([("node", pa.struct([("id", pa.int64())])), ("root", pa.struct([("id", pa.int64())])),
                        ("bands", pa.list_(pa.int64())), ("bag", pa.binary())])
    found = near.block_links(pa.Table.from_pylist(rows[:1], schema), pa.Table.from_pylist(rows[1:], schema))
    assert found.to_pylist() == [{"a": {"id": 1}, "b": {"id": 2}}] and len(compared) == 2
