"""Asset search through a trigram index: `search` of the predicates without a scan of all rows for each text.

The index is three tables below one folder. `postings` has a row for each trigram of a row's searched columns, in lower case,
`grams` how many rows hold each trigram, `rows` the rows by their number. All lie in folders by hash, sorted, so a search
reads only the folders and row groups of its own trigrams and of the rows that they point to.

A text of three characters or more is found through its rarest trigrams: rows that hold all of these are candidates, and
the exact test decides among them. A shorter text has no trigram and is looked for in all rows. Building is one pass and
one shuffle; a trigram in most rows gives many postings, which Spark writes and reads as any other rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from opsframe.plans.predicates import search
from opsframe.plans.session import cut

SIZE = 3
RAREST = 3  # trigrams whose postings are met
FOLDERS = 64


def _folder(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FOLDERS)).cast("int").alias("_folder")


def _grams(columns: list[str]) -> Column:
    """The different trigrams of some columns of a row."""
    def of(column: str) -> Column:
        text = F.coalesce(F.lower(F.col(column).cast("string")), F.lit(""))
        places = F.when(F.length(text) >= SIZE, F.sequence(F.lit(1), F.length(text) - SIZE + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(text, i, F.lit(SIZE)))

    return F.array_distinct(F.flatten(F.array(*[of(c) for c in columns])))


def _write(rows: DataFrame, path: str, order: str) -> None:
    rows.repartition(F.col("_folder")).sortWithinPartitions("_folder", order).write.partitionBy("_folder").parquet(path)


class TrigramIndex:
    """An index at `path`, which `build` makes; later sessions open it by its folder, the rows' schema and the columns."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, others: list[str]):
        self.spark, self.path, self.key, self.others = spark, path, key, others
        own = {"rows": [*schema.fields, StructField("_row", LongType())], "postings": [StructField("gram", StringType()), StructField("_row", LongType())],
               "grams": [StructField("gram", StringType()), StructField("n", LongType())]}
        self.schemas = {name: StructType([*fields, StructField("_folder", IntegerType())]) for name, fields in own.items()}

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str, others: list[str]) -> TrigramIndex:
        numbered = cut(df.withColumn("_row", F.monotonically_increasing_id()))
        _write(numbered.withColumn("_folder", _folder("_row")), f"{path}/rows", "_row")
        postings = numbered.select(F.explode(_grams([key, *others])).alias("gram"), "_row").withColumn("_folder", _folder("gram"))
        postings.hint("rebalance", "_folder").sortWithinPartitions("_folder", "gram").write.partitionBy("_folder").parquet(f"{path}/postings")
        index = cls(df.sparkSession, path, df.schema, key, others)
        counted = index._read("postings").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        _write(counted.withColumn("_folder", _folder("gram")), f"{path}/grams", "gram")
        return index

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def _of(self, name: str, grams: list[str]) -> DataFrame:
        """The entries of some trigrams: a filter on folder and trigram that reaches the scan."""
        folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_folder("gram")).distinct().collect()]
        return self._read(name).filter(F.col("_folder").isin(folders) & F.col("gram").isin(grams))

    def candidates(self, text: str) -> DataFrame:
        """(_row) of the rows that hold the rarest trigrams of a text of SIZE characters or more."""
        needle = text.lower()
        grams = sorted({needle[i:i + SIZE] for i in range(len(needle) - SIZE + 1)})
        counts = {r.gram: r.n for r in self._of("grams", grams).collect()}
        if len(counts) < len(grams):
            return self.spark.createDataFrame([], "_row long")
        rare = sorted(grams, key=lambda g: (counts[g], g))[:RAREST]
        return reduce(lambda a, b: a.join(b, "_row", "left_semi"), [self._of("postings", [g]).select("_row") for g in rare])

    def search(self, text: str) -> DataFrame:
        """The rows that `predicates.search` finds, with their columns."""
        rows = self._read("rows")
        if text and len(text.lower()) >= SIZE:
            found = self.candidates(text).select("_row", _folder("_row"))
            rows = rows.join(found, ["_folder", "_row"], "left_semi")
        return search(rows.drop("_folder", "_row"), text, self.key, self.others)
