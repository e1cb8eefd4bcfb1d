"""Near duplicates by ProbMinHash, banding, and verification.

A document is the multiset of its shingles of five words (digits, letters and anything beyond ASCII, A-Z in lower case; a
text of one to four words is one shingle). Documents with the same words in the same order are copies and share one
representative from here on. Each shingle sends exponential arrivals to the registers of the signature at a rate equal
to its weight, in the order of time, and stops once its next arrival is later than every register's: the registers that
two documents agree on estimate their probability Jaccard. Registers in bands file documents in buckets.

A document is verified against the least member of all its buckets, and if they aren't alike against the least member of
each (exact probability Jaccard of the shingles, 0.8 or more), and components are formed. Where documents of one bucket
still lie in different components, the pairs that share a bucket are verified in blocks, within tasks, so no link that the
bands show is lost. Documents that share no rare shingle with another component can't be alike to it and stay out of this
(`in_play`): pages that have a template in common but a fifth of their own are not compared.

Documents without words are copies of each other if their texts are equal. Rows that repeat a document are copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.components import components
from opsframe.llm.contamination import bitmap, inside_bitmap
from opsframe.llm.store import KEY, KEY_TYPE, keyed, saved, wrapped
from opsframe.llm.text import LETTERS, U64, Hashes, blocks, documents_of, lists, mix, of_bytes, signed, words

SHINGLE = 5
LEAST = 0.8
BAND_ROWS, BANDS = 6, 28
REGISTERS = BAND_ROWS * BANDS
SIDE = 256  # documents on each side of a block
SLOTS = 20  # bits of a slot in the table of how often shingles occur: 2 MB, whatever the input's size


NODE = ["_id", *KEY]


def _node():
    return F.struct(*NODE)


def shingles(data: np.ndarray, offsets: np.ndarray):
    """Per block: hashes of all shingles, where each document's begin, and word sequences' hashes and lengths."""
    starts, ends, first = words(data, offsets, LETTERS)
    hashes = Hashes(Hashes(of_bytes(data, lower=True)).spans(starts, ends))
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(1, n - SHINGLE + 1), 0)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(count, out=begin[1:])
    doc = documents_of(begin, int(begin[-1]))
    at = np.arange(len(doc)) - begin[doc] + first[doc]
    return hashes.spans(at, np.minimum(at + SHINGLE, first[doc + 1])), begin, hashes.spans(first[:-1], first[1:]), n


def weighted(values: np.ndarray, doc: np.ndarray):
    """(document, element, weight) of the distinct elements of each document."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], values[at], np.diff(np.append(at, len(values))).astype(np.float64)


def prob_min_hash(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, REGISTERS) hashes of the elements that arrive first at each register."""
    doc, element, weight = weighted(values, doc)
    time = np.full(n_docs * REGISTERS, np.inf)
    who = np.zeros(n_docs * REGISTERS, np.uint64)
    clock, k = np.zeros(len(doc)), 0
    while len(doc):
        k += 1
        draw = mix(element + U64(k * 0x9E3779B97F4A7C15 % 2**64))
        clock = clock - np.log(((draw >> U64(11)).astype(np.float64) + 0.5) / 2**53) / weight
        register = doc * REGISTERS + (mix(draw ^ U64(0x5851F42D4C957F2D)) % U64(REGISTERS)).astype(np.int64)
        sooner = clock < time[register]
        here, when, whose = register[sooner], clock[sooner], element[sooner]
        np.minimum.at(time, here, when)
        won = time[here] == when
        who[here[won]] = whose[won]
        some = np.unique(doc)
        last = np.zeros(n_docs)
        last[some] = time.reshape(n_docs, REGISTERS)[some].max(1)
        going = clock < last[doc]
        if not going.all():
            doc, element, weight, clock = doc[going], element[going], weight[going], clock[going]
    return who.reshape(n_docs, REGISTERS)


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(BAND_ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def signed_documents(docs: DataFrame) -> DataFrame:
    """(_id, _key, _more, h1, h2, bands): h1 and h2 are equal for copies; bands are empty without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in blocks(batch):
                values, begin, sequence, n = shingles(data, offsets)
                doc, n_docs = documents_of(begin, len(values)), rows.num_rows
                found = bands(prob_min_hash(values, doc, n_docs))
                total = np.zeros(n_docs, np.uint64)
                np.add.at(total, doc, mix(values))  # beside the sequence's hash, a second one of its shingles
                whole = Hashes(of_bytes(data))
                text = whole.spans(offsets[:-1], offsets[1:])
                h1, h2 = np.where(n > 0, sequence, text), np.where(n > 0, total, mix(text) ^ U64(1))
                some = n > 0
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], pa.array(signed(h1)), pa.array(signed(h2)),
                     lists(signed(found[some].ravel()), np.where(some, BANDS, 0))], [*NODE, "h1", "h2", "bands"])

    return docs.select(*NODE, "text").mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, {KEY_TYPE}, h1 long, h2 long, bands array<long>")


def bags(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_id, _key, _more, bag) of the wanted documents: the sorted 64-bit hashes of their shingles, with repetitions, as bytes.

    A bitmap of fixed size picks documents in the scan, so texts aren't shuffled; a few others pass and do no harm.
    """
    place = F.xxhash64(*KEY).alias("fp")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select(place)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(inside_bitmap(shared.value, batch.column(4).to_numpy().view(np.uint64))))
            for rows, data, offsets in blocks(batch):
                values, begin, _, _ = shingles(data, offsets)
                bag = [np.sort(values[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(bag, pa.binary())], [*NODE, "bag"])

    return docs.select(*NODE, "text", place).mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, {KEY_TYPE}, bag binary").dropDuplicates(KEY)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted elements, weights).

    With ratios r = x / y, a common element d has the share 1 / (sum of x over r' >= r / x_d + sum of y over r' < r / y_d).
    """
    (ea, wa), (eb, wb) = a, b
    shared, ia, ib = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = wa[ia], wb[ib]
    if wa.max() == 1 and wb.max() == 1:
        return len(shared) / (len(ea) + len(eb) - len(shared))
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below = np.searchsorted(ratio, ratio, "left")  # elements with a smaller ratio
    up = np.concatenate([[0], np.cumsum(y)])[below] + only_b
    down = x.sum() - np.concatenate([[0], np.cumsum(x)])[below] + only_a
    return float((1 / (down / x + up / y)).sum())


def weights(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    element, n = np.unique(np.frombuffer(bag, np.uint64), return_counts=True)
    return element, n.astype(np.float64)


def alike(a, b) -> bool:
    """similarity >= LEAST; the sizes of sets without repetitions bound it first."""
    few, many = sorted((len(a[0]), len(b[0])))
    if few < LEAST * many and a[1].max() == 1 and b[1].max() == 1:
        return False
    return similarity(a, b) >= LEAST


def verified(edges: DataFrame, bag: DataFrame) -> DataFrame:
    """The edges (a, b) between documents whose similarity is LEAST or more."""
    def named(side):
        return bag.select(_node().alias(side), F.col("bag").alias(f"bag_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x = x.as_py()
                if x is not last and x != last:
                    last, held = x, weights(x)
                keep.append(alike(held, weights(y.as_py())))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = edges.join(named("b"), "b").join(named("a"), "a").select("a", "b", "bag_a", "bag_b")
    return both.mapInArrow(run, edges.select("a", "b").schema)


def _often(bags_of: DataFrame) -> bytes:
    """How many documents hold a shingle, by the leading SLOTS bits of its hash, up to 65,535."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [np.unique(np.frombuffer(x.as_py(), np.uint64)) >> U64(64 - SLOTS) for x in batch.column(0)]
            slot, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *slots]).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    counts = bags_of.select("bag").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.select("slot", F.least("n", F.lit(65535)).cast("int").alias("n")).toArrow()
    out = np.zeros(1 << SLOTS, np.uint16)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out.tobytes()


def rare(bag: bytes, often: np.ndarray) -> np.ndarray:
    """The rarest shingles of a document, as many as leave less than LEAST of its weight to the others.

    Two documents that are alike have a weight of LEAST or more in common, each of its own whole, as no shingle's share of
    the probability Jaccard exceeds its part of either document. So the first of their common shingles, in the same order
    for all documents, is among the rarest of both.
    """
    element, n = weights(bag)
    order = np.lexsort((element, often[(element >> U64(64 - SLOTS)).astype(np.int64)]))
    element, n = element[order], n[order]
    after = np.cumsum(n[::-1])[::-1] / n.sum()  # the weight from this shingle on
    return element[after >= LEAST - 1e-9]


def in_play(opened: DataFrame) -> DataFrame:
    """(at) of the documents (at, coarse, root, bag) that have a rare shingle in common with another root of their group."""
    shared = opened.sparkSession.sparkContext.broadcast(_often(opened))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(shared.value, np.uint16)
        for batch in batches:
            found = [rare(x.as_py(), often) for x in batch.column(3)]
            n = np.array([len(x) for x in found], np.int64)
            values = np.concatenate([np.zeros(0, np.uint64), *found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists(signed(values), n)], ["at", "of", "root", "rare"])

    rows = opened.select("at", F.xxhash64("coarse").alias("of"), F.xxhash64("root").alias("root"), "bag")
    rows = rows.mapInArrow(run, "at long, of long, root long, rare array<long>").select("at", "of", "root", F.explode("rare").alias("rare"))
    rows = saved(rows.select("at", "root", F.xxhash64("of", "rare").alias("rare")), "rare")
    both = rows.groupBy("rare").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("rare")
    return saved(rows.join(both, "rare", "left_semi").select("at").distinct(), "play")


def _opened(groups: DataFrame, every: DataFrame, bag: DataFrame) -> DataFrame:
    """(at, node, coarse, root, bands, bag) of the documents in buckets that hold several roots."""
    several = groups.groupBy("coarse").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    # a table, so that Spark can split the join where a group is hot
    mixed = saved(groups.join(saved(several.select("coarse"), "several"), "coarse", "left_semi"), "mixed")
    held = saved(every.select(_node().alias("node"), "bands").join(mixed, "node").dropDuplicates(["node"]), "held")
    buckets = held.select("node", F.xxhash64("root").alias("root"), F.explode("bands").alias("bucket"))
    both = buckets.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    nodes = saved(buckets.join(both, "bucket", "left_semi").select("node").distinct(), "open")
    held = held.join(nodes, "node", "left_semi").join(bag.select(_node().alias("node"), "bag"), "node")
    return saved(held.select(F.xxhash64("node").alias("at"), "node", "coarse", "root", "bands", "bag"), "opened")


def _between(groups: DataFrame, every: DataFrame, bag: DataFrame) -> DataFrame:
    """Links (a, b) between components (`root`) of one group (`coarse`), for (node, coarse, root).

    Of the documents in play, those outside a group's largest component meet all of the group, in blocks of SIDE by SIDE
    documents, where pairs that share a bucket are verified.
    """
    opened = _opened(groups, every, bag)
    held = opened.join(in_play(opened), "at", "left_semi")
    sizes = saved(held.groupBy("coarse", "root").agg(F.count("*").alias("n")).groupBy("coarse").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("largest"), F.count("*").alias("roots")).where("roots > 1"), "sizes")
    held = held.join(sizes.select("coarse", "n", F.col("largest.root").alias("main"),
                                  (F.col("n") - F.col("largest.n")).alias("out")), "coarse")
    down, across = F.ceil(F.col("out") / SIDE).cast("int"), F.ceil(F.col("n") / SIDE).cast("int")
    held = held.withColumns({"i": F.pmod("at", down).cast("int"), "j": F.pmod("at", across).cast("int"), "down": down, "across": across})
    keys, rest = ["coarse", "i", "j"], ["node", "root", "bands", "bag"]
    left = held.where("root <> main").select("coarse", "i", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"), *rest)
    right = held.select("coarse", F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), "j", *rest)
    kind = groups.schema["node"].dataType.simpleString()
    left, right = left.toDF(*keys, *rest), right.select(*keys, *rest).toDF(*keys, *rest)  # names of their own for Spark
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block_links, f"a {kind}, b {kind}")


def block_links(a: pa.Table, b: pa.Table) -> pa.Table:
    """Links (a, b) between rows (node, root, bands, bag) of two tables whose roots differ and that share a bucket."""
    x, y = (t.select(["node", "root", "bands", "bag"]).to_pylist() for t in (a, b))
    for r in x + y:
        r["root"] = tuple(r["root"].values())
    left, right = (np.array([r["bands"] for r in rows], np.int64).reshape(-1, BANDS) for rows in (x, y))
    meet = np.zeros((len(x), len(y)), bool)
    for k in range(BANDS):
        meet |= left[:, k, None] == right[None, :, k]
    out, joined = [], {}

    def top(r):
        while r in joined:
            r = joined[r]
        return r

    def ready(r):
        if "set" not in r:
            r["weights"] = weights(r["bag"])
            r["set"] = frozenset(r["weights"][0].tolist())
            r["plain"] = r["weights"][1].max() == 1
        return r

    def same(p, q):
        if p["plain"] and q["plain"]:
            few, many = sorted((len(p["set"]), len(q["set"])))
            if few < LEAST * many:
                return False
            both = len(p["set"] & q["set"])
            return both >= LEAST * (few + many - both)
        return bool(p["set"] & q["set"]) and alike(p["weights"], q["weights"])

    for i, j in np.argwhere(meet).tolist():
        p, q = x[i], y[j]
        one, two = top(p["root"]), top(q["root"])
        if one != two and same(ready(p), ready(q)):
            joined[max(one, two)] = min(one, two)
            out.append((p["node"], q["node"]))
    node = a.schema.field("node").type
    return pa.table({"a": pa.array([o[0] for o in out], node), "b": pa.array([o[1] for o in out], node)})


def classes(documents: DataFrame) -> DataFrame:
    """(doc_id, _id, _key, _more, root): root is the least (_id, _key, _more) of the document's class."""
    docs = keyed(documents)
    every = saved(signed_documents(docs), "signatures")
    first = saved(every.groupBy("h1", "h2").agg(F.min(_node()).alias("node")), "copies")
    lead = every.withColumn("node", _node()).join(first.select("node"), "node", "left_semi").dropDuplicates(["node"])
    buckets = lead.select("node", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    stars = saved(buckets.join(least, "bucket").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "stars")
    # a document and the least of its buckets' least members; its other buckets' least members hang on that one
    near = saved(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "stars")
    others = stars.join(near.withColumnRenamed("a", "top"), "b").where("a <> top")
    coarse = components(near.unionByName(others.select("a", F.col("top").alias("b")).distinct()))
    some = stars.select("a").unionByName(stars.select(F.col("b").alias("a"))).distinct().select("a.*")
    bag = saved(bags(docs, some), "bags")
    first_links = saved(verified(near, bag), "links")
    # a document that isn't like the first may be like another
    open_ones = others.join(first_links.select("b"), "b", "left_anti").select("a", "b")
    links = saved(first_links.unionByName(verified(open_ones, bag)), "links")
    fine = components(links)
    groups = saved(coarse.select("node", F.col("root").alias("coarse")).join(fine, "node", "left").select(
        "node", "coarse", F.coalesce("root", "node").alias("root")), "groups")
    more = saved(_between(groups, every, bag), "links")
    roots = components(links.unionByName(more)) if not more.isEmpty() else fine
    of = every.select(*NODE, "h1", "h2").join(first, ["h1", "h2"]).join(roots, "node", "left")
    of = of.select(*NODE, F.coalesce("root", "node").alias("root")).distinct()
    return docs.select("doc_id", *KEY).join(of, KEY).select("doc_id", *NODE, "root")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size, representative, class_key.

    Where ids are null or repeat with other texts, classes may share a class_id; class_key, of the whole key of its first
    document, is a class's own.
    """
    found = saved(classes(documents), "classes")
    sizes = saved(found.groupBy("root").agg(F.count("*").alias("class_size")), "sizes")  # a table, as in _opened
    return found.join(sizes, "root").select("doc_id", F.col("root._id").alias("class_id"), "class_size",
                                            (_node() == F.col("root")).alias("representative"),
                                            F.concat_ws("-", F.hex("root._key"), F.hex("root._more")).alias("class_key"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents, with all their columns, without those that are near duplicates of a lesser doc_id."""
    lead = classes(documents).where(_node() == F.col("root")).select(*KEY).distinct()
    return wrapped(documents).join(lead, KEY, "left_semi").dropDuplicates(KEY).select("_row.*")
