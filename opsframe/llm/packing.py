"""Best-fit packing of tokenised documents into sequences, by hierarchical residual packing.

Each partition tokenises its documents, cuts those that are longer than a sequence, and packs its pieces best-fit, longest
first. Nearly full bins are done. The others are items of the next round, in fewer partitions, packed in the same way,
until one partition is left or, where a partition would exceed ROUND_ITEMS, until rounds no longer help. A bin carries
its pieces (at most one per token), so no join puts them together again. Each round is a table in the shared folder.

A document's tokens are the tokenizer's ids followed by id 0, so a null or empty text is one token. Words are tokenised
once per task: the tokenizer works within white space, so a text's ids are its words' ids. Rows that repeat a document
are packed each.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.store import saved
from opsframe.llm.text import NOT_SPACE, Hashes, blocks, lists, of_bytes, ragged, words

LENGTH = 2048
SLACK = LENGTH // 100  # a bin with less room than this is nearly full
ROUND_ITEMS = 100_000  # of one task in a round
BLOCK_ITEMS = 200_000  # pieces that a task packs at once in the first round
FAN_IN = 8
CACHED_WORDS = 800_000  # about 30 MB; kept from task to task of a Python worker
BATCH = 10_000  # words in one text for the tokenizer
SEPARATOR = "<|endoftext|>"  # a token of its own for the tokenizer, wherever it stands
END = 0
FIELDS = ["doc_id", "piece", "start", "length", "ids_crc32", "offset"]


class Words:
    """Ids of words by their hash; tokenised when first met, forgotten when there are too many."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parting = self.tokenizer.token_to_id(SEPARATOR)
        self.clear()

    def clear(self):
        self.keys, self.start, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        """Words are tokenised by the thousand in one text, with a special token between them, whose id parts the ids again."""
        plain = np.array([SEPARATOR not in t for t in texts])
        ids, count = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        for some, of in ((keys[plain], [t for t, p in zip(texts, plain) if p]), (keys[~plain], [t for t, p in zip(texts, plain) if not p])):
            if not len(some):
                continue
            if of[0].find(SEPARATOR) < 0:
                joined = [SEPARATOR.join(of[i:i + BATCH]) + SEPARATOR for i in range(0, len(of), BATCH)]
                found = np.concatenate([np.array(self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids, "<u4") for t in joined])
                parting = found == self.parting
                ends = np.flatnonzero(parting) - np.arange(len(of))
                n, found = np.diff(ends, prepend=0), found[~parting]
            else:
                each = [e.ids for e in self.tokenizer.encode_batch_fast(of, add_special_tokens=False)]
                n, found = np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], "<u4")
            start = len(self.ids) + len(ids) + np.cumsum(n) - n
            ids = np.concatenate([ids, found])
            at = np.searchsorted(self.keys, some)  # both are sorted
            self.keys, self.start, self.count = (np.insert(x, at, y) for x, y in ((self.keys, some), (self.start, start), (self.count, n)))
        self.ids = np.concatenate([self.ids, ids])

    def ids_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's documents, each followed by END, and where each document begins."""
        starts, ends, first = words(data, offsets, NOT_SPACE)
        hashes = Hashes(of_bytes(data)).spans(starts, ends)
        distinct, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        where = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        inside = where < len(self.keys)
        new[inside] = self.keys[where[inside]] != distinct[inside]
        if new.any():
            if len(self.keys) > CACHED_WORDS:  # all words of the block are learnt anew
                self.clear()
                new[:] = True
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist())])
            where = np.searchsorted(self.keys, distinct)
        of = where[of]
        count = self.count[of]
        before = np.zeros(len(of) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        begin = before[first] + np.arange(len(first))
        out = np.full(begin[-1], END, "<u4")
        ids = self.ids[ragged(self.start[of], count)]
        spread = np.ones(len(out), bool)
        spread[begin[1:] - 1] = False
        out[spread] = ids
        return out, begin


_known: dict[str, Words] = {}


def known_words(path: str) -> Words:
    if path not in _known:
        _known[path] = Words(path)
    return _known[path]


def best_fit(lengths: np.ndarray) -> tuple[list[list[int]], list[int]]:
    """Items of each bin and its fill, longest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(LENGTH + 1)]
    some = 0  # bit r: there are bins with room r
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        high = some >> n
        if high:
            r = n + (high & -high).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                some ^= 1 << r
            bins[b].append(item)
        else:
            b, r = len(bins), LENGTH
            bins.append([item])
            room.append(0)
        r -= n
        room[b] = r
        with_room[r].append(b)
        some |= 1 << r
    return bins, [LENGTH - r for r in room]


def _bins(items: list[np.ndarray], counts: np.ndarray, fills: np.ndarray, ids: pa.Array, first_id: int) -> tuple[pa.RecordBatch, int]:
    """Pack items (bins of the round before, of `counts` pieces each) and write the bins.

    items: piece, start, length, crc and offset of all pieces; ids: their doc_ids.
    """
    bins, filled = best_fit(fills)
    order = np.array([i for b in bins for i in b], np.int64)
    sizes = np.array([len(b) for b in bins], np.int64)
    of = np.repeat(np.arange(len(bins)), sizes)
    before = np.cumsum(fills[order]) - fills[order]
    begin = np.zeros(len(bins), np.int64)
    begin[1:] = np.cumsum(filled)[:-1]
    shift = before - begin[of]
    where = np.cumsum(counts) - counts
    pieces = ragged(where[order], counts[order])
    per_bin = np.bincount(of, counts[order], len(bins)).astype(np.int64)
    piece, start, length, crc, offset = (x[pieces] for x in items)
    offset = offset + np.repeat(shift, counts[order])
    out = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(first_id, first_id + len(bins))), pa.array(np.array(filled, np.int32)), lists(ids.take(pa.array(pieces)), per_bin),
         *(lists(x.astype(np.int64), per_bin) for x in (piece, start, length, crc, offset))],
        ["bin", "fill", *FIELDS])
    return out, first_id + len(bins)


def _first_id(round_: int) -> int:
    return (round_ << 56) | (TaskContext.get().partitionId() << 32)


def _schema(kind: str) -> str:
    return f"bin long, fill int, doc_id array<{kind}>, " + ", ".join(f"{f} array<long>" for f in FIELDS[1:])


def tokenised(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """The first round: bins of each partition's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, next_id = known_words(path), _first_id(0)
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                ids, begin = known.ids_of(data, offsets)
                n = np.diff(begin)
                pieces = -(-n // LENGTH)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = ragged(np.zeros(len(n), np.int64), pieces)
                start = piece * LENGTH
                length = np.minimum(LENGTH, n[doc] - start)
                raw, at = ids.tobytes(), 4 * (begin[doc] + start)
                crc = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())], np.int64)
                held.append((piece, start, length, crc, rows.column(0).take(pa.array(doc))))
                size += len(piece)
                if size >= BLOCK_ITEMS:
                    out, next_id = flush(held, next_id)
                    yield out
                    held, size = [], 0
        if size:
            yield flush(held, next_id)[0]

    def flush(held, next_id):
        piece, start, length, crc = (np.concatenate([h[i] for h in held]) for i in range(4))
        ids = pa.concat_arrays([h[4] for h in held])
        return _bins([piece, start, length, crc, np.zeros(len(piece), np.int64)], np.ones(len(piece), np.int64), length, ids, next_id)

    return docs.mapInArrow(run, _schema(kind))


def repacked(bins: DataFrame, round_: int, kind: str) -> DataFrame:
    """The bins of each partition packed as items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held).combine_chunks()
        column = {c: every.column(c).combine_chunks() for c in every.column_names}
        counts = np.diff(column["piece"].offsets.to_numpy()).astype(np.int64)
        items = [column[c].flatten().to_numpy() for c in FIELDS[1:]]
        fills = column["fill"].to_numpy().astype(np.int64)
        yield _bins(items, counts, fills, column["doc_id"].flatten(), _first_id(round_))[0]

    return bins.mapInArrow(run, _schema(kind))


def packed(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each piece."""
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    docs = documents.select(documents["doc_id"].alias("doc_id"), text.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    bins = saved(tokenised(docs, tokenizer, kind), "packing")
    done, round_, parts, before = [], 0, max(1, bins.rdd.getNumPartitions()), None
    while True:
        full = F.col("fill") > LENGTH - SLACK
        left = bins.where(~full).count()
        fewer = max(1, -(-parts // FAN_IN), -(-left // ROUND_ITEMS))
        if left < 2 or parts == 1 and round_ or fewer == parts and before is not None and left > 0.95 * before:
            done.append(bins)
            break
        done.append(bins.where(full))
        round_, parts, before = round_ + 1, fewer, left
        dealt = bins.where(~full).repartition(parts, F.xxhash64("bin", F.lit(round_)))
        bins = saved(repacked(dealt, round_, kind), "packing")
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    rows = every.select(F.col("bin").alias("sequence_id"), F.inline(F.arrays_zip(*FIELDS)))
    return rows.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")
