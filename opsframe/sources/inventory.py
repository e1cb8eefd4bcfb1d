"""Host inventories, host facts and JSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.plans.model import Model, select_lookups

# The stored facts, in the order of the table.
FACTS = ["hostname", "architecture", "distribution", "distribution_version", "system", "kernel", "ipv4", "ipv6", "devices",
         "domain", "eth0", "eth1", "fqdn", "machine", "machine_id", "mounts", "nodename", "processor", "processor_cores",
         "processor_count", "processor_threads_per_core", "processor_vcpus", "product_name", "product_serial",
         "product_uuid", "product_version", "selinux", "system_vendor", "virtualization_role", "virtualization_type",
         "bios_date", "bios_version"]
FACT_KEYS = {"ipv4": "default_ipv4", "ipv6": "default_ipv6"}
NUMBERS = ["processor_cores", "processor_count", "processor_vcpus"]


def read_facts(lines: DataFrame, text: str, stamp: Column) -> DataFrame:
    """Rows of facts from `host => {json}` lines; nested facts stay JSON text, absent ones are null."""
    line = F.col(text)
    body = F.trim(F.substr(line, F.instr(line, "=>") + F.lit(2)))
    schema = T.StructType([T.StructField("ansible_facts", T.MapType(T.StringType(), T.StringType()))])
    facts = F.from_json(body, schema)["ansible_facts"]
    parsed = lines.withColumn("_facts", facts).filter("_facts IS NOT NULL")

    def one(name: str) -> Column:
        value = F.col("_facts")[f"ansible_{FACT_KEYS.get(name, name)}"]
        return (value.try_cast("int") if name in NUMBERS else value).alias(name)

    return parsed.select(*lines.columns, stamp.alias("last_update"), *[one(n) for n in FACTS])


def inventory_lines(groups: DataFrame) -> DataFrame:
    """Lines of `[group]` blocks from (group, host) rows, sorted; a blank line ends a block.

    Rows are range-sorted by (group, place, host) rather than collected per group.
    """
    one = groups.select("group").distinct()
    head = one.select("group", F.lit(0).alias("place"), F.lit("").alias("host"), F.concat(F.lit("["), "group", F.lit("]")).alias("line"))
    body = groups.select("group", F.lit(1).alias("place"), "host", F.col("host").alias("line"))
    tail = one.select("group", F.lit(2).alias("place"), F.lit("").alias("host"), F.lit("").alias("line"))
    return head.unionByName(body).unionByName(tail).orderBy("group", "place", "host")


def write_inventory(groups: DataFrame, path: str) -> None:
    inventory_lines(groups).select("line").write.text(path)


def as_text(c: Column, kind: T.DataType) -> Column:
    """Dates as yyyy-MM-dd and times as yyyy-MM-dd HH:mm:ss, at every level of a value."""
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[as_text(c[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: as_text(x, kind.elementType))
    return c


def json_of(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as a JSON object with dates as text; null fields are kept."""
    fields = [as_text(F.col(c), df.schema[c].dataType).alias(c) for c in columns or df.columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def export_json(model: Model, lookups: list[str], order: list[str]) -> DataFrame:
    """Text lines that form one JSON array of the chosen own and related columns, in order.

    Only the least order value is looked up, to leave out the comma before the first object; the lines
    are range-sorted, so that the part files written from them concatenate to the document.
    """
    order = list(dict.fromkeys([*order, model.key]))  # the key makes the order total: ties must not share the first place
    rows = select_lookups(model, list(dict.fromkeys([*lookups, *order])))
    rows = rows.withColumn("_at", F.struct(*order))
    first = rows.agg(F.min("_at").alias("_first"))
    comma = F.when(F.col("_at") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    objects = rows.join(F.broadcast(first)).select(F.lit(1).alias("rank"), "_at", F.concat(comma, json_of(rows, lookups)).alias("line"))
    ends = model.frame.sparkSession.range(2).select((F.col("id") * 2).cast("int").alias("rank"),
                                                    F.when(F.col("id") == 0, "[").otherwise("]").alias("line"))
    return objects.unionByName(ends, allowMissingColumns=True).orderBy("rank", "_at").select("rank", "line")


def write_export(lines: DataFrame, path: str) -> None:
    lines.select("line").write.text(path)
