"""Repeated byte strings by suffix arrays, and their removal.

Suffixes can't be sorted in one place, so texts are dealt to shards in which all equal strings of LENGTH bytes meet:
winnowed runs route them (`winnowing`). In a shard, the suffixes that begin a window are sorted by prefix doubling
(cut off at their run's end), and the common prefixes of neighbours follow from the ranks. Arrays are held for a part of a
shard at a time, as only runs of one fingerprint share strings, and not for runs without a window whose hash occurs again. A scan with a stack walks the
tree of common-prefix intervals of LENGTH bytes or more; an interval whose suffixes have different bytes before them
can't be extended to the left: it is a maximal repeat, with all its occurrences. A run's first window counts as different
from all, so repeats that go on beyond a run are found there as well; what the occurrences cover is removed.

Null and empty texts are zero bytes and lose nothing. Rows that repeat a document (id and text) are occurrences of their
own, so what they share goes from each. Matches never cross documents; removal cuts bytes, so kept bytes may not be
whole characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm import winnowing
from opsframe.llm.store import KEY, keyed, one_row_each
from opsframe.llm.text import Hashes, blocks, of_bytes, ragged

LENGTH, GRAM = 400, 128
PART_BYTES = 1 << 18  # of the texts whose suffixes are sorted at once, or one fingerprint's


def suffix_order(text: np.ndarray, left: np.ndarray, length: int):
    """Ranks of prefixes of 7, 14, ... bytes, at least `length` / 2 of the last; `left`: bytes from each place to its run's end.

    A run's end comes before all bytes, so a shorter rest ranks before what it begins.
    """
    n = len(text)
    keys = np.zeros(n, np.int64)
    for i in range(7):
        keys <<= 9
        keys[:max(0, n - i)] |= np.where(left[:max(0, n - i)] > i, text[i:] + np.int16(1), np.int16(0))

    def dense(keys):
        order = np.argsort(keys)
        keys = keys[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(False, keys[1:] != keys[:-1]), dtype=np.int32)
        return rank

    ranks, depth = [(7, dense(keys))], 7
    while 2 * depth < length:
        rank = ranks[-1][1]
        keys = rank.astype(np.int64) * (n + 1)
        keys[:-depth] += np.where(left[:-depth] > depth, rank[depth:] + 1, 0)
        depth *= 2
        ranks.append((depth, dense(keys)))
    return ranks


def edges(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of groups, from whether each member is the first of one."""
    begins = np.flatnonzero(new)
    return begins, np.append(begins[1:], len(new))


def in_order(place: np.ndarray, new: np.ndarray, rank: np.ndarray, depth: int, left: np.ndarray, length: int) -> np.ndarray:
    """The places with those of each group, which share `length` bytes, in the order of what follows."""
    place, new, at = place.copy(), new.copy(), length
    while True:
        begins, ends = edges(new)
        size = ends - begins
        open_ = np.flatnonzero(np.repeat(size > 2, size))  # two have no order to get wrong
        p = place[open_]
        following = np.where(left[p] > at, rank[np.minimum(p + at, len(rank) - 1)] + 1, 0)
        if not following.any():
            return place
        key = np.cumsum(new)[open_] * (len(rank) + 1) + following
        order = np.argsort(key, kind="stable")
        place[open_], key = p[order], key[order]
        new[open_[1:]] |= key[1:] != key[:-1]
        at += depth


def enhanced_suffix_array(text: np.ndarray, left: np.ndarray, before: np.ndarray, length: int):
    """(places, common): the places of the groups that hold maximal repeats, in the order of their suffixes, and for each
    the bytes it shares with the one before, if `length` or more, else 0; `before`: see `maximal_repeats`.

    Suffixes of one group share `length` bytes. A group whose members are all preceded by the same byte holds no
    maximal repeat, nor does any interval in it, so only the others are ordered beyond `length`.
    """
    place = np.flatnonzero(left >= length)
    if not len(place):
        return place, place
    ranks = suffix_order(text, left, length)
    depth, rank = ranks[-1]
    key = rank[place].astype(np.int64) * len(text) + rank[place + length - depth]
    order = np.argsort(key, kind="stable")
    place, key = place[order], key[order]
    new = np.append(True, key[1:] != key[:-1])
    begins, ends = edges(new)
    b = before[place]
    holds = np.repeat(np.minimum.reduceat(b, begins) != np.maximum.reduceat(b, begins), ends - begins)
    place, new = place[holds], new[holds]
    place = in_order(place, new, rank, depth, left, length)
    common = np.zeros(len(place), np.int64)
    pair = np.flatnonzero(~new)
    common[pair] = length
    # beyond `length`: doubling down, then byte by byte
    a, b = place[pair - 1] + length, place[pair] + length
    rest = np.minimum(left[place[pair - 1]], left[place[pair]]) - length
    more = np.zeros(len(pair), np.int64)
    last = len(text) - 1
    for step, rank in [ranks[-1]] * (1 + int(left.max() - length) // depth) + ranks[-2::-1]:
        more += step * ((rest - more >= step) & (rank[np.minimum(a + more, last)] == rank[np.minimum(b + more, last)]))
    for _ in range(7):
        more += (rest - more >= 1) & (text[np.minimum(a + more, last)] == text[np.minimum(b + more, last)])
    common[pair] += more
    return place, common


def maximal_repeats(place: np.ndarray, common: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bytes, places) of each maximal repeat; `before`: what precedes a place, negative and unlike all others at a border."""
    b = before[place]
    for lo, hi in zip(*(x.tolist() for x in edges(common == 0))):
        shared = common[lo:hi].tolist()
        own = b[lo:hi].tolist()
        # the stack holds open intervals: (bytes, first suffix, the byte before all of its suffixes or None if they differ)
        stack: list[list] = []
        for i in range(1, hi - lo + 1):
            depth = shared[i] if i < hi - lo else 0
            first, byte = i - 1, own[i - 1]
            while stack and stack[-1][0] > depth:
                size, first, held = stack.pop()
                byte = held if held == byte else None
                if byte is None:
                    yield size, place[lo + first:lo + i]
            if not depth:
                continue
            if stack and stack[-1][0] == depth:
                if stack[-1][2] != byte:
                    stack[-1][2] = None
            else:
                stack.append([depth, first, byte])


def suffixes(variants: list[bytes], length: int):
    """(text of each place, its begin, places, common, before) of texts put together: see `enhanced_suffix_array`."""
    text = np.frombuffer(b"".join(variants), np.uint8)
    if len(text) >> 31:
        raise ValueError("the texts of one part have 2**31 bytes or more")
    sizes = np.array([len(v) for v in variants], np.int64)
    end = np.cumsum(sizes)
    begin = end - sizes
    of = np.repeat(np.arange(len(variants), dtype=np.int32), sizes)
    left = np.repeat(end.astype(np.int32), sizes) - np.arange(len(text), dtype=np.int32)
    before = np.empty(len(text), np.int32)
    before[1:] = text[:-1]
    before[begin[sizes > 0]] = -1 - np.flatnonzero(sizes > 0)
    return of, begin, *enhanced_suffix_array(text, left, before, length), before


def repeats_of_shard(variants: list[bytes], length: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], list[list[tuple[int, int]]]]:
    """Maximal repeats of a shard's texts as (bytes, occurrences (text, place)), and for each text what they cover."""
    of, begin, place, common, before = suffixes(variants, length)
    groups, spans = [], [[] for _ in variants]
    for size, found in maximal_repeats(place, common, before):
        at = [(int(t), int(p)) for t, p in zip(of[found], found - begin[of[found]])]
        groups.append((size, at))
        for t, p in at:
            spans[t].append((p, p + size))
    return groups, [merged(s) for s in spans]


def covered(variants: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each text what its maximal repeats cover, from the longest one at each place."""
    of, begin, place, common, before = suffixes(variants, length)
    longest = np.zeros(len(of), np.int32)
    for size, found in maximal_repeats(place, common, before):
        longest[found] = np.maximum(longest[found], size)
    at = np.flatnonzero(longest)
    spans: list[list[tuple[int, int]]] = [[] for _ in variants]
    if len(at):
        ends = np.maximum.accumulate(at + longest[at])
        new = np.append(True, (at[1:] > ends[:-1]) | (of[at[1:]] != of[at[:-1]]))
        firsts, lasts = edges(new)
        text = of[at[firsts]]
        for t, a, b in zip(text.tolist(), (at[firsts] - begin[text]).tolist(), (ends[lasts - 1] - begin[text]).tolist()):
            spans[t].append((a, b))
    return spans


def window_hashes(variants: list[bytes], length: int) -> np.ndarray:
    """The hashes of the windows of texts of `length` bytes or more, one text after the other."""
    found, at = [np.zeros(0, np.uint64)], 0
    sizes = np.array([len(v) for v in variants], np.int64)
    ends = np.cumsum(sizes)
    while at < len(variants):
        last = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + PART_BYTES, "right")))
        hashes = Hashes(of_bytes(np.frombuffer(b"".join(variants[at:last]), np.uint8)))
        window = ragged(ends[at:last] - sizes[at:last] - (ends[at] - sizes[at]), sizes[at:last] - length + 1)
        found.append(hashes.spans(window, window + length))
        at = last
    return np.concatenate(found)


def spans_of(fp: pa.ChunkedArray, units: pa.ChunkedArray, length: int) -> list[list[tuple[int, int]]]:
    """For each run of a shard (its fingerprint and its bytes, `length` or more) what repeats in it."""
    fp, variants = fp.to_numpy(), units.to_pylist()
    spans: list[list[tuple[int, int]]] = [[] for _ in variants]
    if not len(fp):
        return spans
    hashes = window_hashes(variants, length)
    order = np.argsort(hashes)
    again = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(hashes), bool)
    twice[order[1:]] = again
    twice[order[:-1]] |= again
    windows = np.array([len(v) - length + 1 for v in variants])
    rows = np.flatnonzero(np.logical_or.reduceat(twice, np.cumsum(windows) - windows))
    del hashes, order, again, twice
    rows = rows[np.argsort(fp[rows], kind="stable")]
    parts: list[list[int]] = [[]]
    size = 0
    for own in np.split(rows, np.flatnonzero(fp[rows[1:]] != fp[rows[:-1]]) + 1):
        more = sum(len(variants[i]) for i in own)
        if size and size + more > PART_BYTES:
            parts.append([])
            size = 0
        parts[-1] += own.tolist()
        size += more
    for part in filter(None, parts):
        for i, found in zip(part, covered([variants[i] for i in part], length)):
            spans[i] = found
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS_ARROW = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def span_lists(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"from": a, "to": b} for a, b in s] for s in spans], _SPANS_ARROW)


def repeated_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(_key, _more, start, spans): what repeats in each run, in bytes from the run's start; `docs` from `store.keyed`.

    Rows that repeat a document don't add to the work: at most two of them stand for all.
    """
    one, again = one_row_each(docs)
    found = winnowing.repeating(one.unionByName(again), gram, length)
    every, cold, hot = winnowing.contested(found)

    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        return pa.table({"fp": table["fp"], "variant": table["variant"], "spans": span_lists(spans_of(table["fp"], table["units"], length))})

    texts = winnowing.shards(cold, one, length, None, 1)
    own = texts.groupBy("shard").applyInArrow(shard, f"fp long, variant long, spans {winnowing.SPANS}")
    parts = own.where(F.size("spans") > 0).unionByName(winnowing.hot_windows(one, hot, length))
    return winnowing.repeated_parts(found, parts, every, length)


def repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed: what repeats in each document and the digest of the rest."""
    docs = keyed(documents)
    by = repeated_runs(docs, length, gram).groupBy(*KEY).agg(F.collect_list(F.struct("start", "spans")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                removed, kept = [], []
                column = rows.column(2)
                for i in range(rows.num_rows):
                    text = data[offsets[i]:offsets[i + 1]]
                    gone = merged([(r["start"] + s["from"], r["start"] + s["to"]) for r in column[i].as_py() or () for s in r["spans"]])
                    digest, at = hashlib.sha256(), 0
                    for a, b in gone:
                        digest.update(text[at:a].tobytes())
                        at = b
                    digest.update(text[at:].tobytes())
                    removed.append(gone)
                    kept.append(digest.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(offsets)), pa.array([sum(b - a for a, b in g) for g in removed], pa.int64()),
                     pa.array([len(g) for g in removed], pa.int64()), pa.array(kept, pa.string()), span_lists(removed)],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.join(by, KEY, "left").select("doc_id", "text", "runs").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed {winnowing.SPANS}")
