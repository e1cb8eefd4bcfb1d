"""A shard's runs are handled in parts, so its arrays don't grow with it."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from llm import brute
from opsframe.llm import repeats


def columns(rows):
    return pa.chunked_array([pa.array([r[0] for r in rows], pa.int64())]), pa.chunked_array([pa.array([r[1] for r in rows], pa.binary())])


@pytest.mark.parametrize("seed", range(10))
def test_parts_find_what_brute_force_finds(seed, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 300)
    r = np.random.default_rng(seed)
    rows = []
    for fp in range(8):  # bytes of each fingerprint are its own
        base = bytes((r.integers(0, 3, 90) + 3 * fp).astype(np.uint8))
        cuts = [(a, a + n) for a, n in zip(r.integers(0, 60, 21), r.integers(6, 50, 21))]
        rows += [(fp, b"".join(base[a:b] for a, b in cuts[i:i + 3])) for i in range(0, 21, 3)]
    rows = [rows[i] for i in r.permutation(len(rows)) if len(rows[i][1]) >= 16]
    found = repeats.spans_of(*columns(rows), 16)
    texts = [t for _, t in rows]
    assert [bytes(any(a <= i < b for a, b in s) for i in range(len(t))) for t, s in zip(texts, found)] == [bytes(h) for h in brute.repeated(texts, 16)]
    assert found == repeats.repeats_of_shard(texts, 16)[1]


def test_no_rows_and_no_repeats():
    assert repeats.spans_of(*columns([]), 16) == []
    assert repeats.spans_of(*columns([(1, b"abcdefghijklmnop"), (1, b"bcdefghijklmnopq")]), 16) == [[], []]


def test_arrays_are_smaller_than_a_shard_would_need():
    r = np.random.default_rng(5)
    rows = []
    for fp in range(400):
        body = r.integers(0, 256, 3000).astype(np.uint8).tobytes()
        rows += [(fp, body[i * 9:i * 9 + 2900 + i]) for i in range(3)]
    size = sum(len(t) for _, t in rows)
    fp, units = columns(rows)
    repeats.window_hashes([rows[0][1]], 400)  # powers that a worker keeps
    tracemalloc.start()
    found = repeats.spans_of(fp, units, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(len(s) == 1 for s in found)
    assert peak < 60 * size  # 130 when all suffixes of a shard are sorted together
