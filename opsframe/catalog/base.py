"""Registry and the example tables and models."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from opsframe.plans.model import Model

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


class Shop:
    """lineitem -> orders -> customer -> nation -> region, lineitem -> part, supplier -> nation."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _model(self, name: str, key: str) -> Model:
        return Model(name, table(self._spark, self._folder, name), key)

    @cached_property
    def region(self) -> Model:
        return self._model("region", "r_regionkey")

    @cached_property
    def nation(self) -> Model:
        return self._model("nation", "n_nationkey").link("region", "n_regionkey", self.region)

    @cached_property
    def customer(self) -> Model:
        return self._model("customer", "c_custkey").link("nation", "c_nationkey", self.nation)

    @cached_property
    def supplier(self) -> Model:
        return self._model("supplier", "s_suppkey").link("nation", "s_nationkey", self.nation)

    @cached_property
    def part(self) -> Model:
        return self._model("part", "p_partkey")

    @cached_property
    def orders(self) -> Model:
        return self._model("orders", "o_orderkey").link("customer", "o_custkey", self.customer)

    @cached_property
    def lineitem(self) -> Model:
        lines = self._model("lineitem", "l_orderkey").link("order", "l_orderkey", self.orders)
        return lines.link("part", "l_partkey", self.part).link("supplier", "l_suppkey", self.supplier)
