"""Repeats whose occurrences aren't neighbours until their suffixes are sorted beyond the least length."""

from itertools import permutations

import numpy as np
import pytest

from llm import brute
from opsframe.llm import repeats


def covered(texts, spans):
    return [bytes(any(a <= i < b for a, b in s) for i in range(len(t))) for t, s in zip(texts, spans)]


@pytest.mark.parametrize("order", list(permutations(range(4))))
def test_occurrences_apart_share_more_than_the_one_between(order):
    texts = [[b"1abcdefghijklmnopxyz1", b"2abcdefghijklmnopuvw", b"3abcdefghijklmnopxyz3", b"abcdefghijklmnopxy"][i] for i in order]
    groups, spans = repeats.repeats_of_shard(texts, 16)
    assert covered(texts, spans) == [bytes(h) for h in brute.repeated(texts, 16)]
    assert sorted((size, len(found)) for size, found in groups) == [(16, 4), (18, 3), (19, 2)]


@pytest.mark.parametrize("seed", range(20))
def test_pieces_of_one_text(seed):
    r = np.random.default_rng(seed)
    base = bytes(r.integers(0, 3, 90).astype(np.uint8))
    cuts = [(a, a + n) for a, n in zip(r.integers(0, 60, 40), r.integers(5, 50, 40))]
    texts = [b"".join(base[a:b] for a, b in cuts[i:i + 3]) for i in range(0, 40, 3)]
    groups, spans = repeats.repeats_of_shard(texts, 16)
    assert covered(texts, spans) == [bytes(h) for h in brute.repeated(texts, 16)]
    for size, found in groups:
        string, = {texts[t][p:p + size] for t, p in found}
        assert sorted(found) == [(t, p) for t, x in enumerate(texts) for p in range(len(x) - size + 1) if x[p:p + size] == string]


def test_repeated_bytes_beyond_the_length(shipped):
    r = np.random.default_rng(3)
    body = "".join(map(chr, r.integers(97, 123, 400)))
    rows = [(i, f"{i}#{body}{'end' if i % 2 else 'tail of another kind'}{i % 3}") for i in range(12)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(x)[:5] for x in repeats.repeats(docs).collect()) == sorted(brute.op3(rows))
