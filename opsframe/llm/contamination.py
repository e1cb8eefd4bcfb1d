"""Benchmark decontamination by winnowing.

Fingerprints are the least 5-gram hashes of sliding windows of 10 words, so every shared span of 10 words shares at
least one. Those of the documents pass a bitmap of fixed size made of the benchmark's, the rest meet the benchmark's in
a join, and each hit is extended word by word. Items of fewer than 10 words are looked for whole.

Null and empty texts have no words; items without words never occur. Rows that repeat an item_id count as one item with
several texts. A null item_id is written as the empty string. Rows that repeat a document get the same result each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.store import KEY, KEY_TYPE, keyed, saved, wrapped
from opsframe.llm.text import LETTERS, U64, Hashes, blocks, documents_of, lists, mix, of_bytes, ragged, signed, winnow, words

SPAN, GRAM = 10, 5
SIDE = SPAN - GRAM
BITS = 25  # of a place in the bitmap: 4 MB, whatever the benchmark's size
FOUND = f"{KEY_TYPE}, n_words long, fp long, pos int, length int, around array<long>"


def _fingerprints(values: np.ndarray, first: np.ndarray, short: list[int], whole_only: bool):
    """(document, position, length, fingerprint) of the winnowed 5-grams, and of spans of the `short` lengths.

    whole_only: only spans that are a whole text, as for the items of a benchmark.
    """
    hashes, n = Hashes(values), int(first[-1])
    grams = hashes.grams(GRAM)
    _, _, chosen = winnow(grams, first, GRAM, SPAN)
    chosen = np.unique(chosen)
    doc = documents_of(first, n)
    out = [(doc[chosen], chosen, np.full(len(chosen), GRAM), grams[chosen])]
    for length in short:
        here = np.arange(max(0, n - length + 1))
        here = here[here + length <= first[doc[here] + 1]]
        if whole_only:
            here = here[(here == first[doc[here]]) & (here + length == first[doc[here] + 1])]
        if len(here):
            out.append((doc[here], here, np.full(len(here), -length), mix(hashes.spans(here, here + length) + U64(length))))
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(docs: DataFrame, short: list[int], whole_only: bool, shared=None) -> DataFrame:
    """A row without fp for each document, and a row per fingerprint with the hashes of the words around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                starts, ends, first = words(data, offsets, LETTERS)
                values = Hashes(of_bytes(data, lower=True)).spans(starts, ends)
                doc, pos, length, fp = _fingerprints(values, first, short, whole_only)
                if bits is not None:
                    hit = inside_bitmap(bits, fp)
                    doc, pos, length, fp = doc[hit], pos[hit], length[hit], fp[hit]
                there = ragged(pos - SIDE, np.full(len(pos), SPAN + SIDE))
                of = np.repeat(doc, SPAN + SIDE)
                inside = (there >= first[of]) & (there < first[of + 1])
                around = values[np.clip(there, 0, max(0, len(values) - 1))] if len(values) else np.zeros(0, np.uint64)
                around = pa.array(signed(around), mask=~inside)
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(np.diff(first).astype(np.int64)), pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))],
                    [*KEY, "n_words", "fp", "pos", "length", "around"])
                if len(pos):
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.nulls(len(pos), pa.int64()),
                         pa.array(signed(fp)), pa.array((pos - first[doc]).astype(np.int32)), pa.array(length.astype(np.int32)),
                         lists(around, np.full(len(pos), SPAN + SIDE))],
                        [*KEY, "n_words", "fp", "pos", "length", "around"])

    return docs.select(*KEY, "text").mapInArrow(run, FOUND)


def bitmap(prints: DataFrame) -> bytes:
    """One bit for the leading BITS bits of each `fp`; at most 2**19 rows come here, whatever the table's size."""
    place = F.shiftrightunsigned("fp", 64 - BITS)
    parts = prints.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[parts["word"].to_numpy()] = parts["bits"].to_numpy()
    return out.tobytes()


def inside_bitmap(bits: bytes, fp: np.ndarray) -> np.ndarray:
    place = fp >> U64(64 - BITS)
    return (np.frombuffer(bits, np.uint8)[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1 == 1


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their number of words, and (document, item, from, to) in words for each extended hit.

    `docs` and `items` come from `store.keyed`; an item's doc_id is its item_id.
    """
    spark = docs.sparkSession
    prints = saved(_scan(items, list(range(1, SPAN)), True).join(
        items.select(*KEY, F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("item")).distinct(), KEY), "items")
    prints = prints.where("fp is not null").select("fp", "item", "length", F.col("around").alias("theirs")).distinct()
    short = sorted(-r.length for r in prints.where("length < 0").select("length").distinct().collect())  # 9 at most
    found = saved(_scan(docs, short, False, spark.sparkContext.broadcast(bitmap(prints))), "fingerprints")
    same = F.zip_with("around", "theirs", lambda x, y: F.coalesce(x == y, F.lit(False)))
    met = found.where("fp is not null").join(prints, ["fp", "length"]).withColumn("same", same)

    def reach(side):
        at = F.array_position(side, False)
        return F.when(at == 0, F.lit(SIDE)).otherwise((at - 1).cast("int"))

    left = reach(F.reverse(F.slice("same", 1, SIDE)))
    right = reach(F.slice("same", SPAN + 1, SIDE))
    core = ~F.array_contains(F.slice("same", SIDE + 1, GRAM), False)
    spans = met.select(*KEY, "item", "length", "pos", left.alias("left"), right.alias("right"), core.alias("core"))
    spans = spans.where(f"length < 0 or (core and left + right >= {SIDE})").select(
        *KEY, "item", F.expr("if(length < 0, pos, pos - left)").alias("from"),
        F.expr(f"if(length < 0, pos - length, pos + {GRAM} + right)").alias("to"))
    return found.where("fp is null").select(*KEY, "n_words"), spans


def covered(spans):
    """How many units an array of (from, to) covers."""
    end = F.struct(F.lit(0).cast("int").alias("to"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), end, lambda at, x: F.struct(
        F.greatest(at["to"], x["to"]).alias("to"),
        (at["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(at["to"], x["from"]))).cast("long").alias("n")))["n"]


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """n_words, n_hit (words in any shared span of 10, or in a whole shorter item), the items met, and whether there are any."""
    docs = keyed(documents)
    counts, spans = hits(docs, keyed(benchmark, "item_id"))
    by = spans.groupBy(*KEY).agg(F.collect_set(F.struct("from", "to")).alias("spans"), F.collect_set("item").alias("items"))
    by = by.select(*KEY, covered(F.col("spans")).alias("n_hit"), F.array_sort("items").alias("items"))
    found = counts.distinct().join(by, KEY, "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    ids = docs.select("doc_id", *KEY)
    return ids.join(found, KEY).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"))


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, in which no span of the benchmark occurs."""
    _, spans = hits(keyed(documents), keyed(benchmark, "item_id"))
    return wrapped(documents).join(spans.select(*KEY).distinct(), KEY, "left_anti").select("_row.*")
