"""Required and default columns, JSON, fingerprints, frame headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.sources.inventory import json_of


def shape(df: DataFrame, required: list[str] = (), defaults: dict | None = None) -> DataFrame:
    """Check required columns and fill in defaults.

    A list column gives its last element, unless its default is a list; then a plain column becomes a
    one-element list. Missing columns take the default.
    """
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise KeyError(f"missing columns {absent}")
    defaults = defaults or {}
    out = []
    for f in df.schema:
        c, wants_list = F.col(f.name), isinstance(defaults.get(f.name), list)
        if isinstance(f.dataType, T.ArrayType):
            c = c if wants_list else F.try_element_at(c, F.lit(-1))
        elif wants_list:
            c = F.array(c)
        if f.name in defaults:
            c = F.coalesce(c, _literal(defaults[f.name]))
        out.append(c.alias(f.name))
    return df.select(*out, *[_literal(v).alias(n) for n, v in defaults.items() if n not in df.columns])


def _literal(value) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def if_else(condition: Column, then, otherwise=None) -> Column:
    """A null condition counts as false."""
    return F.when(condition, then).otherwise(otherwise)


def parse_json(df: DataFrame, column: str, schema) -> DataFrame:
    """Text to a nested column; text that is not JSON gives null."""
    return df.withColumn(column, F.from_json(column, schema))


def emit_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Rows plus their JSON text, dates as text at all levels."""
    return df.withColumn(name, json_of(df))


def read_field(json: Column, path: str, default=None) -> Column:
    """A field or list element of JSON text, e.g. `a.b[0]`, or the default."""
    return F.coalesce(F.get_json_object(json, f"$.{path}"), F.lit(default))


def fingerprint(*parts: Column) -> Column:
    """md5 of the joined parts."""
    return F.md5(F.concat(*[p.cast("string") for p in parts]))


def call_key(prefix: str, *parts: Column) -> Column:
    """`prefix_md5` of a call signature; null parts take part as `None`."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.md5(F.concat_ws("$", F.lit(prefix), *texts)))


def salted(salt: Column, secret: Column) -> Column:
    """`salt$sha1(salt + secret)`."""
    return F.concat(salt, F.lit("$"), F.sha1(F.concat(salt, secret)))


def verify(secret: Column, stored: Column) -> Column:
    """Does the secret match the stored digest? False for null or malformed digests."""
    salt = F.substring_index(stored, "$", 1)
    return F.coalesce(F.contains(stored, F.lit("$")) & (salted(salt, secret) == stored), F.lit(False))


def _number(frame: Column, offset: int, length: int) -> Column:
    return F.conv(F.hex(F.substring(frame, offset + 1, length)), 16, 10).cast("long")


def ethernet(frame: Column) -> dict[str, Column]:
    """Destination, source (hex) and type of an Ethernet frame."""
    return {"eth_dst": F.lower(F.hex(F.substring(frame, 1, 6))), "eth_src": F.lower(F.hex(F.substring(frame, 7, 6))),
            "eth_type": _number(frame, 12, 2)}


# IPv4 header fields as (offset behind the Ethernet header, length).
IPV4_FIELDS = {"version_ihl": (0, 1), "tos": (1, 1), "length": (2, 2), "ident": (4, 2), "flags_offset": (6, 2), "ttl": (8, 1),
               "protocol": (9, 1), "checksum": (10, 2), "ip_src": (12, 4), "ip_dst": (16, 4)}


def ipv4(frame: Column) -> dict[str, Column]:
    return {n: _number(frame, 14 + o, size) for n, (o, size) in IPV4_FIELDS.items()}


def traffic(frames: DataFrame, column: str) -> DataFrame:
    """Frames and bytes per (source, destination, protocol)."""
    h = ipv4(F.col(column))
    return frames.select(h["ip_src"].alias("ip_src"), h["ip_dst"].alias("ip_dst"), h["protocol"].alias("protocol"),
                         h["length"].alias("_l")).groupBy("ip_src", "ip_dst", "protocol").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("_l").alias("bytes"))
