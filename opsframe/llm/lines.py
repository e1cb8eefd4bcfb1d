"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z in lower case. Each batch of documents gives a sorted run
(hash, number of documents). Keys already known to be frequent leave the batch by an anti-join with the settled run; the
rest is added to level 0. A level with `fanout` runs is merged into one run of the next level, and keys that reach the
threshold go to the settled run. A last merge of all levels settles the rest.

A null or empty text is one empty line. Keys without a code point are never dropped. Rows that repeat a document are
documents of their own where they are counted. Extra columns are kept by `without_frequent_lines`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.store import KEY, keyed, let, saved, wrapped

HASH = ["h1", "h2"]
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(key):
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Sorted runs of (h1, h2, n) in levels, and the settled run of keys with n >= least."""

    def __init__(self, least: int = 10, fanout: int = 4):
        self.least, self.fanout = least, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.settled: DataFrame | None = None

    @staticmethod
    def _run(counts: DataFrame) -> DataFrame:
        return saved(counts.sortWithinPartitions(*HASH), "line-run")

    def add(self, counts: DataFrame) -> None:
        """Add a batch: (h1, h2, n), each key once."""
        if self.settled is not None:
            counts = counts.join(self.settled, HASH, "left_anti")
        self.levels[0].append(self._run(counts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self._merge(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        """One run of the keys that stay below the threshold; the others are settled."""
        every = runs[0]
        for run in runs[1:]:
            every = every.unionByName(run)
        if self.settled is not None:
            every = every.join(self.settled, HASH, "left_anti")
        merged = saved(every.groupBy(*HASH).agg(F.sum("n").alias("n")), "line-merge")
        reached = merged.where(F.col("n") >= self.least).select(*HASH)
        self.settled = self._run(reached if self.settled is None else reached.unionByName(self.settled))
        return self._run(merged.where(F.col("n") < self.least))

    def frequent(self) -> DataFrame | None:
        """All keys that reach the threshold; None without any batch."""
        left = [run for level in self.levels for run in level]
        if left:
            self.levels = [[self._merge(left)]]
        return self.settled


def frequent_lines(docs: DataFrame, least: int, batches: int, fanout: int) -> DataFrame:
    """Hashes of the keys that are found in `least` documents or more; `docs` from `store.keyed`."""
    keys = let(F.split("text", "\n", -1), lambda lines: F.array_distinct(F.filter(
        F.transform(lines, line_key), lambda k: F.length(k) > 0)))
    batch = F.pmod(F.xxhash64(*KEY, F.lit("batch")), F.lit(batches)).cast("int")
    each = docs.select(batch.alias("batch"), F.inline(F.transform(keys, _hashes)))
    counted = saved(each.groupBy("batch", *HASH).agg(F.count("*").alias("n")), "line-batches")
    runs = LineRuns(least, fanout)
    for b in range(batches):
        runs.add(counted.where(F.col("batch") == b).select(*HASH, "n"))
    return runs.frequent()


def dropped_lines(docs: DataFrame, least: int, batches: int, fanout: int) -> DataFrame:
    """(_key, _more, dropped): the sorted positions of each document's frequent lines."""
    frequent = frequent_lines(docs, least, batches, fanout)
    hashes = let(F.split("text", "\n", -1), lambda lines: F.transform(lines, lambda x: let(line_key(x), lambda k: F.when(
        F.length(k) > 0, _hashes(k)))))
    each = docs.select(*KEY, F.posexplode(hashes).alias("pos", "h")).where("h is not null").select(*KEY, "pos", "h.*")
    return each.join(frequent, HASH).groupBy(*KEY).agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def kept_lines(lines, dropped):
    """`lines` without those at the sorted positions `dropped`, by slices between them."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1)))


def line_dedup(documents: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, _key, _more, n_lines, n_dropped, kept): every text without the lines that `least` documents or more share."""
    docs = keyed(documents)
    found = docs.join(dropped_lines(docs, least, batches, fanout), KEY, "left")
    none = F.array().cast("array<int>")
    parts = let(F.struct(F.split("text", "\n", -1).alias("lines"), F.coalesce("dropped", none).alias("dropped")), lambda x: F.struct(
        F.size(x["lines"]).cast("long").alias("n_lines"), F.size(x["dropped"]).cast("long").alias("n_dropped"),
        F.array_join(kept_lines(x["lines"], x["dropped"]), "\n").alias("kept")))
    return found.select("doc_id", *KEY, parts.alias("x")).select("doc_id", *KEY, "x.*")


def without_frequent_lines(documents: DataFrame, least: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """The documents with all their columns; `text` loses its frequent lines, n_chars (if any) follows. Null texts stay null."""
    docs = keyed(documents)
    found = wrapped(documents).join(dropped_lines(docs, least, batches, fanout), KEY, "left")
    text = let(F.struct(F.split("_row.text", "\n", -1).alias("lines"), F.col("dropped").alias("dropped")),
               lambda x: F.array_join(kept_lines(x["lines"], x["dropped"]), "\n"))
    row = F.col("_row").withField("text", text)
    if "n_chars" in documents.columns:
        row = let(row, lambda r: r.withField("n_chars", F.length(r["text"]).cast(documents.schema["n_chars"].dataType)))
    return found.select(F.when(F.col("dropped").isNull(), F.col("_row")).otherwise(row).alias("_row")).select("_row.*")


#: DuckDB
LINE_DEDUP_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) > 0 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
