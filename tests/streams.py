"""A query that is run again and again as rows come in."""

from opsframe.streaming import keyed as K


class Runs:
    """Runs of one query, each with more rows; gives the new rows that come out."""

    def __init__(self, spark, folder, schema, build):
        self.spark, self.folder, self.schema, self.build, self.n, self.seen = spark, folder, schema, build, 0, 0

    def __call__(self, rows):
        path, out = str(self.folder / "in"), str(self.folder / "out")
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{path}/part={self.n}")
        self.n += 1
        self.query = K.run_batches(self.build(self.spark.readStream.schema(self.schema).parquet(f"{path}/part=*")), out, str(self.folder / "check"))
        self.query.awaitTermination()
        new = [r for r in self.spark.read.parquet(out).collect() if r.batch >= self.seen]
        self.seen = 1 + max((int(p["batchId"]) for p in self.query.recentProgress), default=self.seen - 1)
        return new
