"""Repeated passages by Aho-Corasick automata, and their removal.

Winnowed runs of windows of LENGTH words show where passages may recur (`winnowing`). Recurring passages are confirmed in
shards by fingerprint: a variant that occurs twice recurs whole, of others the windows that two variants share. Then the
documents are dealt to shards of about SHARD_BYTES, and each shard takes every confirmed passage that its documents can
hold once. A shard's words are numbered, its passages are compiled into one automaton over these numbers, and all of its
documents are streamed through it: every occurrence is found, overlapping ones included, and its words are removed.

Words are runs of anything but ASCII white space. Null and empty texts have none. Rows that repeat a document (id and
text) are occurrences of their own, so a text of LENGTH words or more goes from each. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm import winnowing
from opsframe.llm.repeats import span_lists
from opsframe.llm.store import KEY, KEY_TYPE, keyed, one_row_each, saved
from opsframe.llm.text import NOT_SPACE, Hashes, of_bytes, parts, ragged, words

LENGTH, GRAM = 35, 8
SHARD_BYTES = 6 << 20
BASE = 64  # of the digits of a word's number: a node of the automaton searches its children one by one, so it gets few


def confirmed(variants: list[np.ndarray], fp: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each variant (word hashes), the stretches of words whose windows another variant of its fingerprint shares."""
    sizes = np.array([len(v) for v in variants], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(0, sizes - length + 1)
    window = ragged(begin, n)
    of = np.repeat(np.arange(len(variants)), n)
    h = Hashes(np.concatenate(variants) if variants else np.zeros(0, np.uint64)).spans(window, window + length) ^ fp.view(np.uint64)[of]
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    out: list[list[tuple[int, int]]] = [[] for _ in variants]
    hit = np.flatnonzero(count[inverse] > 1)
    if not len(hit):
        return out
    breaks = np.flatnonzero((np.diff(window[hit]) != 1) | (np.diff(of[hit]) != 0)) + 1
    for a, b in zip(np.append(0, breaks).tolist(), np.append(breaks, len(hit)).tolist()):
        v = of[hit[a]]
        first = window[hit[a]] - begin[v]
        out[v].append((int(first), int(first + (b - a) - 1 + length)))
    return out


def recurring(one: DataFrame, again: DataFrame, length: int, gram: int) -> DataFrame:
    """(_key, _more, start, n, fp, variant, spans): confirmed passages in words from each run's start; see `store.one_row_each`."""
    found = winnowing.repeating(one.unionByName(again), gram, length, NOT_SPACE)
    every, cold, hot = winnowing.contested(found)

    def shard(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        variants = [np.frombuffer(u, np.uint64) for u in table["units"].to_pylist()]
        spans = confirmed(variants, table["fp"].to_numpy(), length)
        return pa.table({"fp": table["fp"], "variant": table["variant"], "spans": span_lists(spans)})

    texts = winnowing.shards(cold, one, length, NOT_SPACE, 8)
    own = texts.groupBy("shard").applyInArrow(shard, f"fp long, variant long, spans {winnowing.SPANS}")
    shared = own.where(F.size("spans") > 0).unionByName(winnowing.hot_windows(one, hot, length, NOT_SPACE))
    return winnowing.repeated_parts(found, shared, every, length)


def characters(numbers: np.ndarray, width: int) -> str:
    """Word numbers as `width` characters each, digits of base BASE."""
    digits = np.empty((len(numbers), width), "<u4")
    rest = numbers.astype(np.int64)
    for i in range(width):
        digits[:, i] = rest % BASE
        rest = rest // BASE
    return digits.tobytes().decode("utf-32-le")


def occurrences(automaton, text: str, width: int, n: int) -> np.ndarray:
    """Which of a document's n words lie in an occurrence; values of the automaton are lengths in words."""
    change = np.zeros(n + 1, np.int64)
    found = list(automaton.iter(text))
    if not found:
        return np.zeros(n, bool)
    end, size = np.array(found, np.int64).T
    whole = (end + 1) % width == 0
    at = (end[whole] + 1) // width
    np.add.at(change, at - size[whole], 1)
    np.add.at(change, at, -1)
    return np.cumsum(change[:n]) > 0


def strip_shard(rows: pa.Table, places: pa.Table) -> pa.Table:
    """Remove the occurrences of the shard's passages from all of its documents.

    rows: _key, _more, text, each document once; places: _key, _more, start, spans, one for each passage that the documents may hold.
    """
    import ahocorasick

    rows = rows.combine_chunks()
    batch = rows.to_batches()[0]
    column = batch.column(batch.schema.get_field_index("text"))
    data, offsets = parts(column)
    starts, ends, first = words(data, offsets, NOT_SPACE)
    hashes = Hashes(of_bytes(data)).spans(starts, ends)
    distinct, number = np.unique(hashes, return_inverse=True)
    width = 1
    while BASE ** width <= len(distinct):
        width += 1
    text = characters(number, width)
    where = {}
    for i, key in enumerate(zip(*(rows[k].to_pylist() for k in KEY))):
        where.setdefault(key, i)
    automaton = ahocorasick.Automaton()
    for r in places.to_pylist():
        base = int(first[where[tuple(r[k] for k in KEY)]]) + r["start"]
        for s in r["spans"]:
            a, b = base + s["from"], base + s["to"]
            automaton.add_word(text[a * width:b * width], b - a)
    if len(automaton):
        automaton.make_automaton()
    n_words, n_removed, digest = [], [], []
    for i in range(len(rows)):
        a, b = int(first[i]), int(first[i + 1])
        gone = occurrences(automaton, text[a * width:b * width], width, b - a) if len(automaton) and b > a else np.zeros(b - a, bool)
        keep = np.flatnonzero(~gone) + a
        size = ends[keep] - starts[keep]
        out = np.full(int(size.sum()) + max(0, len(keep) - 1), 0x20, np.uint8)
        out[ragged(np.cumsum(size) - size + np.arange(len(keep)), size)] = data[ragged(starts[keep], size)]
        n_words.append(b - a)
        n_removed.append(int(gone.sum()))
        digest.append(hashlib.sha256(out.tobytes()).hexdigest())
    return pa.table({**{k: rows[k] for k in KEY}, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                     "kept_sha256": pa.array(digest, pa.string())})


def without_passages(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    docs = keyed(documents)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    one, again = one_row_each(docs)  # rows that repeat a document share its result
    shard = F.pmod(F.xxhash64(*KEY, F.lit("shard")), F.lit(max(1, -(-int(total) // SHARD_BYTES)))).cast("int").alias("shard")
    places = recurring(one, again, length, gram).withColumn("shard", shard)
    # a passage that several documents of a shard hold is taken from the first of them
    once = places.groupBy("shard", "fp", "variant").agg(F.min(F.struct(*KEY, "start", "spans")).alias("p")).select("shard", "p.*")
    left = one.select(shard, *KEY, "text").toDF("shard", *KEY, "text")
    right = once.toDF("shard", *KEY, "start", "spans")
    stripped = saved(left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(
        lambda a, b: strip_shard(a.drop_columns(["shard"]), b), f"{KEY_TYPE}, n_words long, n_removed long, kept_sha256 string"), "stripped")
    return docs.select("doc_id", *KEY).join(stripped, KEY).select("doc_id", "n_words", "n_removed", "kept_sha256")
