"""Secret scans with linked credentials.

One pass finds the base spans and the parts of multipart credentials: access identifiers, weak secrets (long mixed
strings that no base pattern names) and endpoints. Parts are joined by interval within their scope: a weak secret is
reported only if an identifier and an endpoint, or an identifier alone of the strong form, lie within `SCOPE` code points
of it in the same document; all identifiers and endpoints that support it are reported too.

Null and empty texts have no spans. Rows that repeat a document get the same spans each. Offsets are code points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsframe.llm.repeats import merged
from opsframe.llm.store import KEY, KEY_TYPE, keyed, saved

SCOPE = 400
KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
# The parts.
IDENTIFIER = re.compile(r"(?:user(?:_?name)?|login|client_?id|account|access_?key(?:_?id)?)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})", re.I | re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[a-z])(?=[A-Za-z0-9+/_=-]*[A-Z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]{4,}|\b(?:host|endpoint|server|region)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{4,}", re.I | re.A)
#: A text without any of these needs no regular expression: each pattern's matches hold one.
_MAYBE = re.compile(r"[:=]|AKIA|[0-9a-f]{16}|[0-9]")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost and non-overlapping per kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def part_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Identifiers, weak secrets outside the base spans, and endpoints."""
    taken = merged([(a, b) for a, b, _ in base])
    ends = [b for _, b in taken]
    secrets = []
    for m in SECRET.finditer(text):
        i = bisect_right(ends, m.start())  # the first base span that ends behind the secret's start
        if i == len(taken) or taken[i][0] >= m.end():
            secrets.append((m.start(), m.end(), "secret"))
    if not secrets:
        return []
    named = [(m.start(1), m.end(1), "identifier") for m in IDENTIFIER.finditer(text)]
    return secrets + named + [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]


_SPAN = "array<struct<start:int,end:int,kind:int>>"


def _scan(docs: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))

    def packed(spans):
        return sorted({(a, b, KINDS.index(k)) for a, b, k in spans}, key=lambda x: (x[0], x[2], x[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, rest = [], []
            for text in batch.column(3):
                text = text.as_py()
                if not text or not _MAYBE.search(text) and not HEX.search(text):
                    base.append([])
                    rest.append([])
                    continue
                found = base_spans(text)
                base.append([dict(zip(("start", "end", "kind"), x)) for x in packed(found)])
                rest.append([dict(zip(("start", "end", "kind"), x)) for x in packed(part_spans(text, found))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(base, kind), pa.array(rest, kind)],
                                             ["doc_id", *KEY, "base", "parts"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {KEY_TYPE}, base {_SPAN}, parts {_SPAN}"
    return docs.select("doc_id", *KEY, "text").mapInArrow(run, schema)


def linked(parts: DataFrame) -> DataFrame:
    """Of (_key, _more, start, end, kind), the weak secrets with complementary parts in their scope, and those parts.

    An interval join: each part is filed under the stretch of the text where it begins and a secret looks into its own
    and the two beside it, so a long document is spread by stretch.
    """
    stretch = F.floor(F.col("start") / SCOPE).cast("int")
    secrets = parts.where(F.col("kind") == KINDS.index("secret")).select(
        *KEY, F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(stretch - 1, stretch + 1)).alias("stretch"))
    # a part supports every secret near it, so one row per part and secret is the size of the answer
    others = parts.where(F.col("kind") != KINDS.index("secret")).select(*KEY, "start", "end", "kind", stretch.alias("stretch"))
    near = secrets.join(others, [*KEY, "stretch"]).where(F.abs(F.col("start") - F.col("s")) <= SCOPE)
    # the parts of one secret begin within 2 * SCOPE + 1 code points, so their set is small
    got = near.groupBy(*KEY, "s", "e").agg(F.collect_set(F.struct("start", "end", "kind")).alias("others"))

    def some(kind):
        return F.exists("others", lambda x: x["kind"] == KINDS.index(kind))

    got = got.where(some("access") | some("identifier") & some("endpoint"))
    whole = F.struct(F.col("s").alias("start"), F.col("e").alias("end"), F.lit(KINDS.index("secret")).alias("kind"))
    return got.select(*KEY, F.explode(F.concat(F.array(whole), "others")).alias("x")).select(*KEY, "x.*").distinct()


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, base and added spans as arrays of (start, end, kind) with kind an index of KINDS."""
    found = saved(_scan(keyed(documents)), "secrets")
    weak = found.where(F.size("parts") > 0)
    parts = weak.select(*KEY, F.explode(F.concat("parts", F.filter("base", lambda x: x["kind"] == KINDS.index("access")))).alias("x"))
    added = linked(parts.select(*KEY, "x.*").distinct()).where(F.col("kind") >= 3).groupBy(*KEY).agg(
        F.collect_set(F.struct("start", "end", "kind")).alias("added"))
    return found.join(added, KEY, "left").select("doc_id", "base", F.coalesce("added", F.array().cast(_SPAN)).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The counts per kind, the digest of the base spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"])))
        return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
                        text(F.concat("base", "added")).alias("spans"))
