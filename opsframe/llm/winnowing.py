"""Repeated windows of a corpus, found through winnowed runs.

A run is a stretch of consecutive windows of one document that select the same k-gram. Its fingerprint is the hash of
that k-gram, its variant the hash of all it covers. Equal windows lie in runs of one fingerprint, at equal distances from
the k-gram. So windows repeat within fingerprints that occur twice or more; of these, a fingerprint with one variant
repeats whole, and only different variants of one fingerprint have to be compared in their texts, each of them once.

A fingerprint with many variants is hot: it isn't gathered but split by the hashes of its windows (`hot_windows`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.contamination import bitmap, inside_bitmap
from opsframe.llm.store import KEY, KEY_TYPE, saved
from opsframe.llm.text import Hashes, blocks, documents_of, lists, mix, of_bytes, ragged, signed, winnow, words

N_BITS = 9  # of a run's number of windows
START_BITS = 31  # of its first window: places in a document are ints
HOT = 20_000  # variants of one fingerprint that are compared in one task at most
SHARD_BYTES = 2 << 20


def units(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The values of a block's bytes or words, and the place where each document begins."""
    if inside is None:
        return of_bytes(data), offsets
    starts, ends, first = words(data, offsets, inside)
    return Hashes(of_bytes(data)).spans(starts, ends), first


def runs_of(values: np.ndarray, first: np.ndarray, k: int, length: int):
    """(document, start in it, windows, fingerprint, variant) of each run of a block."""
    hashes = Hashes(values)
    grams = hashes.grams(k)
    start, n, chosen = winnow(grams, first, k, length)
    if not len(start):
        return start, start, n, start.astype(np.uint64), start.astype(np.uint64)
    variant = hashes.spans(start, start + n - 1 + length)
    variant = mix(variant + (chosen - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    doc = documents_of(first, first[-1])[start]
    return doc, start - first[doc], n, grams[chosen], variant


def runs(docs: DataFrame, k: int, length: int, inside: np.ndarray | None = None, bits=None) -> DataFrame:
    """(fp, variant, _key, _more, at) of all runs, or of those whose fingerprint passes the bitmap; `docs` from `store.keyed`.

    `at` packs the first window and the number of windows; the document's key has columns of its own, whole.
    """
    assert length - k + 1 < 1 << N_BITS

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                doc, start, n, fp, variant = runs_of(*units(data, offsets, inside), k, length)
                if bits is not None:
                    hit = inside_bitmap(bits.value, fp)
                    doc, start, n, fp, variant = doc[hit], start[hit], n[hit], fp[hit], variant[hit]
                if not len(doc):
                    continue
                if start.max() >> START_BITS:
                    raise ValueError(f"a document has more than 2**{START_BITS} units")
                at = start << N_BITS | n
                yield pa.RecordBatch.from_arrays([pa.array(signed(fp)), pa.array(signed(variant)), *(
                    rows.column(i).take(pa.array(doc)) for i in range(len(KEY))), pa.array(at)], ["fp", "variant", *KEY, "at"])

    return docs.select(*KEY, "text").mapInArrow(find, f"fp long, variant long, {KEY_TYPE}, at long")


def unpacked(df: DataFrame) -> DataFrame:
    """`at` as start and n."""
    return df.withColumns({"start": F.shiftright("at", N_BITS).cast("int"),
                           "n": F.col("at").bitwiseAND((1 << N_BITS) - 1).cast("int")}).drop("at")


def repeating(docs: DataFrame, k: int, length: int, inside: np.ndarray | None = None) -> DataFrame:
    """The runs whose fingerprint occurs twice or more, and whether its variants differ (`contested`).

    A first pass counts fingerprints. Those that repeat pass a bitmap of fixed size, so most single runs never meet the
    join; it decides exactly.
    """
    twice = saved(runs(docs, k, length, inside).groupBy("fp").agg(
        F.count("*").alias("n"), F.min("variant").alias("low"), F.max("variant").alias("high")).where("n > 1").select(
        "fp", (F.col("low") != F.col("high")).alias("contested")), "twice")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(twice))
    return saved(runs(docs, k, length, inside, bits).join(twice, "fp"), "runs")


def with_texts(docs: DataFrame, places: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """`fn(rows, data, offsets)` over the documents with places, listed per document in the last column `places`
    as structs of fp, variant, start, n."""
    listed = unpacked(places).groupBy(*KEY).agg(F.collect_list(F.struct("fp", "variant", "start", "n")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                yield from fn(rows, data, offsets)

    return docs.select(*KEY, "text").join(listed, KEY).mapInArrow(run, schema)


def places_of(rows: pa.RecordBatch, first: np.ndarray):
    """fp, variant, first unit in the block, windows, and document of the places of a block's documents."""
    column = rows.column(3)
    each = column.flatten()
    doc = np.repeat(np.arange(rows.num_rows), np.diff(column.offsets.to_numpy()))
    fp, variant, start, n = (each.field(i).to_numpy() for i in range(4))
    return fp, variant, start.astype(np.int64) + first[doc], n.astype(np.int64), doc


def contested(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One place of each variant of contested fingerprints, (fp, variant, copies, _key, _more, at): all, the ordinary and the hot ones."""
    one = saved(found.where("contested").groupBy("fp", "variant").agg(
        F.count("*").alias("copies"), F.min(F.struct(*KEY, "at")).alias("p")).select("fp", "variant", "copies", "p.*"), "variants")
    hot = saved(one.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("fp"), "hot")
    return one, one.join(hot, "fp", "left_anti"), one.join(hot, "fp", "left_semi")


SPANS = "array<struct<from:int,to:int>>"


def repeated_parts(found: DataFrame, parts: DataFrame, every: DataFrame, length: int) -> DataFrame:
    """(_key, _more, start, n, fp, variant, spans) of the runs that repeat, the spans in units from the run's start.

    found: from `repeating`; every: all variants from `contested`; parts: what repeats in single ones.
    """
    whole = F.array(F.struct(F.lit(0).alias("from"), (F.col("n") - 1 + length).alias("to"))).cast(SPANS)
    known = saved(every.select("fp", "variant", "copies").join(parts, ["fp", "variant"], "left").where(
        "copies > 1 or spans is not null"), "parts")  # a table, so that Spark can split the next join where a variant is hot
    rows = unpacked(found)
    columns = [*KEY, "start", "n", "fp", "variant"]
    return rows.where("not contested").select(*columns, whole.alias("spans")).unionByName(
        rows.where("contested").join(known, ["fp", "variant"]).select(
            *columns, F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")).alias("spans")))


def hot_windows(docs: DataFrame, places: DataFrame, length: int, inside: np.ndarray | None = None) -> DataFrame:
    """(fp, variant, spans): the repeated windows of hot fingerprints, counted by the hash of each window."""

    def each(rows, data, offsets):
        values, first = units(data, offsets, inside)
        fp, variant, start, n, _ = places_of(rows, first)
        window = ragged(start, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(fp, n)), pa.array(np.repeat(variant, n)), pa.array(ragged(np.zeros(len(n), np.int64), n).astype(np.int32)),
             pa.array(signed(Hashes(values).spans(window, window + length)))], ["fp", "variant", "at", "h"])

    windows = saved(with_texts(docs, places, each, "fp long, variant long, at int, h long").distinct(), "hot-windows")
    twice = windows.groupBy("fp", "h").agg(F.count("*").alias("n")).where("n > 1").select("fp", "h")
    return windows.join(twice, ["fp", "h"]).groupBy("fp", "variant").agg(F.collect_set(F.struct(
        F.col("at").alias("from"), (F.col("at") + length).alias("to"))).alias("spans"))


def shards(places: DataFrame, docs: DataFrame, length: int, inside: np.ndarray | None, fill: int) -> DataFrame:
    """(shard, fp, variant, n, units): the texts of variants, those of one fingerprint in one shard of about SHARD_BYTES.

    Bytes are given as they are, words as their hashes.
    """
    total = unpacked(places).agg(F.sum(F.col("n") + length)).first()[0] or 0
    number = max(1, -(-int(total) * fill // SHARD_BYTES))

    def each(rows, data, offsets):
        if inside is None:
            values, first = data, offsets
        else:
            values, first = units(data, offsets, inside)
        fp, variant, start, n, _ = places_of(rows, first)
        size = n - 1 + length
        raw = values[ragged(start, size)].view(np.uint8)
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(size * values.itemsize, out=ends[1:])
        text = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
        shard = (mix(fp.view(np.uint64)) % np.uint64(number)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp), pa.array(variant), pa.array(n.astype(np.int32)), text],
                                         ["shard", "fp", "variant", "n", "units"])

    return with_texts(docs, places, each, "shard int, fp long, variant long, n int, units binary")
