"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words, byte n-grams of its words, and repetitions of a word; a
softmax over two classes follows. It is trained by stochastic gradient descent on a bounded sample of labelled documents
on the driver; executors need one number per bucket, the bucket's vector times the difference of the two classes.

Words are runs of anything but ASCII white space. An empty or null text is scored by the bias alone. Without labels of
both classes every score is the share of label 1, or 0.5 without any. Rows that repeat a document get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.sampling import held_out, labelled
from opsframe.llm.text import NOT_SPACE, U64, Hashes, blocks, documents_of, mix, of_bytes, words

BITS = 18
GRAMS = (3, 4)
PER_CLASS, LONGEST = (1000, 1000), 20_000
THRESHOLD = 0.3


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) arrays of a block: words, repetitions, n-grams."""
    starts, ends, first = words(data, offsets, NOT_SPACE)
    hashes = Hashes(of_bytes(data))
    doc = documents_of(first, len(starts))
    values = hashes.spans(starts, ends)
    shift = U64(64 - BITS)
    yield doc, (values >> shift).astype(np.int64)
    again = np.flatnonzero((values[1:] == values[:-1]) & (doc[1:] == doc[:-1])) + 1
    yield doc[again], np.zeros(len(again), np.int64)  # one bucket for a word that repeats the one before
    left = np.repeat(ends, ends - starts)  # where each byte's word ends
    at = np.flatnonzero(NOT_SPACE[data])
    of = np.repeat(doc, ends - starts)
    for k in GRAMS:
        inside = at + k <= left
        here = at[inside]
        yield of[inside], (mix(hashes.spans(here, here + k) + U64(k)) >> shift).astype(np.int64)


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all texts one after the other, their shares, and where each text's begin."""
    buckets, shares, sizes = [], [], []
    for _, data, offsets in blocks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
        parts = list(features(data, offsets))
        doc, bucket = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        pair, n = np.unique(doc << BITS | bucket, return_counts=True)
        doc = pair >> BITS
        buckets.append((pair & ((1 << BITS) - 1)).astype(np.int32))
        shares.append((n / np.bincount(doc, n, len(offsets) - 1)[doc]).astype(np.float32))
        sizes.append(np.bincount(doc, minlength=len(offsets) - 1))
    return np.concatenate(buckets), np.concatenate(shares), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def fit(texts: list[str], labels: list[int], share: float, dim: int = 8, epochs: int = 8, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """(number per bucket, bias): the logit of label 1 is the bias plus the mean of the buckets' numbers."""
    known = np.array(labels)
    if len(set(labels)) < 2:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p)))
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    buckets, shares, begin = _bags(texts)
    weight = np.where(known == 1, share * len(known) / known.sum(), (1 - share) * len(known) / (1 - known).sum())
    weight = np.sqrt(weight)  # between the sample's balance and the table's
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(texts)):
            bucket, part = buckets[begin[i]:begin[i + 1]], shares[begin[i]:begin[i + 1]]
            mean = part @ vectors[bucket]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[known[i]] -= 1
            p *= step * weight[i]
            back = p @ out
            out -= np.outer(p, mean)
            bias -= p * 0.1
            scale = np.float32(min(50.0, len(bucket)))  # a bag's gradient is spread over its buckets
            vectors[bucket] -= scale * part[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def scores(documents: DataFrame, model: tuple[np.ndarray, float], columns: list[str]) -> DataFrame:
    """`columns` of the documents with `score`, the probability of label 1."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model[0].tobytes(), model[1]))
    text = F.coalesce(documents["text"].cast("string"), F.lit(""))
    given = documents.select(*[documents[c] for c in columns], text.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bias = np.frombuffer(shared.value[0], np.float32), shared.value[1]
        for batch in batches:
            for rows, data, offsets in blocks(batch, "__text"):
                total, n = np.zeros(rows.num_rows), np.zeros(rows.num_rows)
                for doc, bucket in features(data, offsets):
                    total += np.bincount(doc, numbers[bucket], rows.num_rows)
                    n += np.bincount(doc, minlength=rows.num_rows)
                z = bias + total / np.maximum(n, 1)
                score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(score)], [*columns, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{kinds}, score double")


def model_of(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return fit(*labelled(documents, labels, "quality", PER_CLASS, LONGEST))


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = scores(documents, model_of(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score THRESHOLD or more."""
    rows = documents.select(F.struct("*").alias("_row"), documents["text"].alias("text"))
    return scores(rows, model_of(documents, labels), ["_row"]).where(F.col("score") >= THRESHOLD).select("_row.*")
