"""Spelling variants: words that differ by one code point, found with a pair dictionary of trie nodes.

The words stand in two tries, one forward and one of their reversals, whose nodes are numbered. A prefix and a suffix are
thus an integer each, and a pair of integers is a string with one place marked in it. Every word gives

  * for each place, the pair around it, with that place skipped;
  * for each place between code points, and both ends, the pair that meets there, where one could be inserted.

Two words of one skipped pair differ by a replaced code point. A skipped pair of one word that is a meeting pair of
another says that the first has one code point more; of a run of equal code points only the first may be skipped, so each
longer word meets each shorter one once. Grouped by its pair, the join needs no list of word pairs: a pair holds at most
one meeting word and as many skipping words as there are code points (90 in the runs taken here), whatever the table is.
From each group every word gets the number of its neighbours there and the best of them.

Numbering is spread over sorted ranges of words. Next to the word before it in order, a word adds a node for each code
point past their common prefix; one path is held at a time. Where ranges meet, the first word's path takes over the nodes
it shares with the last word before it, from a table of one row per range. Nodes of whole words rise with code-point order.

Null texts have no words; a null id counts as the empty text where ids decide on deletions. Rows that repeat a document
are counted each. Texts are read in stretches cut between runs, so their length is free, and a word costs rows in
proportion to its length. Words, counts and ties are defined by the columns alone: extra columns don't matter. Without
words there are no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.store import saved

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST = 7  # code points of a word
LEAST = 2  # occurrences of a word
TIMES = 10  # a form occurs so many times as often as its variant
ERRORS = 31  # of so many occurrences, by the hash of id and run, one loses a code point
STRETCH = 1 << 20
HELD_WORDS = 200_000  # of a task, counted before they go on
HELD_NODES = 1 << 20
PART_BITS = 40  # of a node's number within its range


def runs(text: str, longest: int = STRETCH) -> Iterator[list[str]]:
    """The maximal runs of at least SHORTEST letters, A-Z in lower case, of stretches of the text."""
    run, other, begin = re.compile(f"[{LETTERS}]{{{SHORTEST},}}"), re.compile(f"[^{LETTERS}]"), 0
    while begin < len(text):
        end = min(len(text), begin + longest)
        if end < len(text):
            found = other.search(text, end)
            end = found.start() if found else len(text)
        part = text[begin:end].encode().translate(bytes.maketrans(UPPER.encode(), LOWER.encode())).decode()
        yield run.findall(part)
        begin = end


def misspelt(doc_id: str, run: str) -> str:
    """The run, less a code point where the hash of id and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % ERRORS else run[:at] + run[at + 1:]


def words(documents: DataFrame) -> DataFrame:
    """(word, n) of the words of all texts."""
    docs = documents.select(F.coalesce(documents["doc_id"].cast("string"), F.lit("")).alias("id"),
                            documents["text"].cast("string").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc = doc.as_py()
                for some in runs(text.as_py()):
                    for r, n in Counter(some).items():
                        held[misspelt(doc, r)] += n
                    if len(held) > HELD_WORDS:
                        yield flush(held)
        if held:
            yield flush(held)

    def flush(held: Counter[str]) -> pa.RecordBatch:
        kept = {w: n for w, n in held.items() if len(w) >= SHORTEST}
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    counted = docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST)


def shared(a: str, b: str) -> int:
    """The length of the common prefix."""
    n, size = 0, min(len(a), len(b))
    while n < size and a[n] == b[n]:
        n += 1
    return n


def numbered(rows: DataFrame, key: str, name: str) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """`rows`, each `key` once, with the trie nodes of key's prefixes, the empty one first, as array<long> `name`; and, by
    range, the nodes that the first word takes over from the ranges before it (`taken_over`)."""
    sorted_ = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    columns = [*rows.columns, name, "_edge"]
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, count = TaskContext.get().partitionId() << PART_BITS, 0
        before, path, last = "", np.zeros(0, np.int64), None
        for batch in batches:
            begin, held, paths = 0, 0, []
            for i, word in enumerate(batch.column(at).to_pylist()):
                keep = shared(before, word) + 1 if len(path) else 0
                path = np.concatenate([path[:keep], first + count + np.arange(len(word) + 1 - keep)])
                count, before = count + len(word) + 1 - keep, word
                paths.append(path)
                held += len(path)
                if held >= HELD_NODES or i + 1 == len(batch):
                    out = made(batch.slice(begin, i + 1 - begin), paths, 1 if last is None else 0)
                    if last is not None:
                        yield last
                    begin, held, paths, last = i + 1, 0, [], out
        if last is not None:
            edge = last.column(len(columns) - 1).to_numpy(zero_copy_only=False).copy()
            edge[-1] += 2
            yield last.set_column(len(columns) - 1, "_edge", pa.array(edge))

    def made(rows: pa.RecordBatch, paths: list[np.ndarray], first: int) -> pa.RecordBatch:
        edge = np.zeros(len(paths), np.int32)
        edge[0] = first
        ends = np.cumsum([0, *map(len, paths)]).astype(np.int32)
        nodes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(paths)))
        return pa.RecordBatch.from_arrays([*rows.columns, nodes, pa.array(edge)], columns)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    made_rows = saved(sorted_.mapInArrow(run, f"{fields}, {name} array<long>, _edge int"), f"trie-{name}")
    ends = made_rows.where("_edge > 0").select(F.shiftright(F.element_at(name, -1), PART_BITS).alias("part"), "_edge", F.col(key).alias("key"),
                                               F.col(name).alias("nodes")).orderBy("part", "_edge").collect()
    return made_rows.drop("_edge"), taken_over([(r.part, r._edge, r.key, np.array(r.nodes)) for r in ends])


def taken_over(ends: list[tuple[int, int, str, np.ndarray]]) -> dict[int, np.ndarray]:
    """By range, the true numbers of the first nodes: those on the path to the last word of the range before it.

    ends: (range, 1 first, 2 last or 3 both, word, nodes) in order. A range numbers its first word's nodes from 0.
    """
    out: dict[int, np.ndarray] = {}
    last, true = "", np.zeros(0, np.int64)
    for part, edge, word, nodes in ends:
        if edge & 1 and len(true):
            out[part] = true[:shared(last, word) + 1]
        if edge & 2:
            last, true = word, renumbered(nodes, out)
    return out


def renumbered(nodes: np.ndarray, over: dict[int, np.ndarray]) -> np.ndarray:
    """Nodes of one range by their true numbers."""
    if not len(nodes):
        return nodes
    first = nodes[-1] >> PART_BITS
    if first not in over:
        return nodes
    old = over[first]
    local = nodes - (first << PART_BITS)
    inside = local < len(old)
    out = nodes.copy()
    out[inside] = old[local[inside]]
    return out


SKIP, SKIP_FIRST, MEET = 0, 1, 2  # an entry's kind; SKIP_FIRST skips the first of a run of equal code points


def pairs(tried: DataFrame, forward: dict[int, np.ndarray], backward: dict[int, np.ndarray]) -> DataFrame:
    """(p, s, kind, n, id): the pairs of all words (word, n, forward, backward), whose id is the node of the whole word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, out = 0, []
            for word, n, f, b in zip(*(batch.column(i) for i in range(4))):
                code = np.frombuffer(word.as_py().encode("utf-32-le"), np.uint32)
                f, b = renumbered(f.values.to_numpy(), forward), renumbered(b.values.to_numpy(), backward)[::-1]
                kind = np.full(2 * len(code) + 1, MEET, np.int8)
                kind[:len(code)] = SKIP_FIRST
                kind[1:len(code)][code[1:] == code[:-1]] = SKIP
                out.append((np.concatenate([f[:-1], f]), np.concatenate([b[1:], b]), kind,
                            np.full(len(kind), n.as_py()), np.full(len(kind), f[-1])))
                held += len(kind)
                if held >= HELD_NODES:
                    yield flush(out)
                    held, out = 0, []
            if out:
                yield flush(out)

    def flush(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["p", "s", "kind", "n", "id"])

    return tried.select("word", "n", "forward", "backward").mapInArrow(run, "p long, s long, kind byte, n long, id long")


def neighbours(entries: DataFrame) -> DataFrame:
    """(id, n_near, best) with best = (n, -id) of the near word that occurs most, the least id of equals.

    A group of a pair is bounded, see above, and groups of one entry go before anything is made of them.
    """
    entry = F.struct("n", (-F.col("id")).alias("less"), "kind")
    met = entries.groupBy("p", "s").agg(F.sort_array(F.collect_list(entry), False).alias("all")).where(F.size("all") > 1)
    met = met.select("all", F.get(F.filter("all", lambda x: x["kind"] == MEET), F.lit(0)).alias("meet"), F.filter("all", lambda x: x["kind"] != MEET).alias("skips"),
                     F.filter("all", lambda x: x["kind"] == SKIP_FIRST).alias("firsts"))

    def word(x):
        return F.struct(x["n"].alias("n"), x["less"].alias("less"))

    none = F.lit(None).cast("struct<n: bigint, less: bigint>")
    replaced = F.transform("skips", lambda x, i: F.struct(
        x["less"].alias("less"), (F.size("skips") - 1 + F.when((x["kind"] == SKIP_FIRST) & F.col("meet").isNotNull(), 1).otherwise(0)).alias("near"),
        F.greatest(F.when(F.size("skips") > 1, word(F.get("skips", F.when(i == 0, 1).otherwise(0)))).otherwise(none),
                   F.when((x["kind"] == SKIP_FIRST) & F.col("meet").isNotNull(), word(F.col("meet"))).otherwise(none)).alias("best")))
    longer = F.when(F.col("meet").isNotNull() & (F.size("firsts") > 0), F.array(F.struct(
        F.col("meet.less").alias("less"), F.size("firsts").alias("near"), word(F.get("firsts", F.lit(0))).alias("best")))).otherwise(F.array())
    each = met.select(F.inline(F.concat(replaced, longer.cast("array<struct<less: bigint, near: int, best: struct<n: bigint, less: bigint>>>"))))
    return each.where("near > 0").groupBy((-F.col("less")).alias("id")).agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def variants(documents: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word, the near word that it is a variant of, and where its forms lead."""
    counted = saved(words(documents), "words")
    forward, over = numbered(counted, "word", "forward")
    turned = forward.withColumn("_turned", F.reverse("word"))
    both, under = numbered(turned, "_turned", "backward")
    both = both.drop("_turned")
    near = neighbours(pairs(both, over, under))
    listed = both.select("word", "n", F.element_at("forward", -1).alias("id"))
    found = listed.join(near, "id", "left").withColumn("form_id", F.when(F.col("best.n") >= TIMES * F.col("n"), -F.col("best.less")))
    found = saved(found.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_id"), "near-words")
    steps = found.where("form_id is not null").select("id", "form_id")
    # Each step multiplies n by TIMES, so there are few.
    root = steps.withColumnRenamed("form_id", "root_id")
    following = steps.select(F.col("id").alias("root_id"), F.col("form_id").alias("_next"))
    while True:
        ahead = saved(root.join(following, "root_id", "left"), "roots")
        root = ahead.select("id", F.coalesce("_next", "root_id").alias("root_id"))
        if ahead.where("_next is not null").isEmpty():
            break
    form = found.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    roots = root.join(found.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    out = found.join(form, "form_id", "left").join(roots, "id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
