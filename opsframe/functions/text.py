"""Cleaning key columns, and finding things in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strip_prefixes(c: Column, prefixes) -> Column:
    """Remove each prefix once, in the given order."""
    for p in [prefixes] if isinstance(prefixes, str) else prefixes:
        c = F.when(c.startswith(p), F.substr(c, F.lit(len(p) + 1))).otherwise(c) if p else c
    return c


def strip_suffixes(c: Column, suffixes) -> Column:
    """Remove each suffix once, in the given order."""
    for s in [suffixes] if isinstance(suffixes, str) else suffixes:
        c = F.when(c.endswith(s), F.substr(c, F.lit(1), F.length(c) - F.lit(len(s)))).otherwise(c) if s else c
    return c


def strip_both(c: Column, parts) -> Column:
    return strip_suffixes(strip_prefixes(c, parts), parts)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def int_or(c: Column, default: int | None = None) -> Column:
    """Whole number or the default."""
    return F.coalesce(F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint")), F.lit(default).cast("bigint"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9_\-]+", "-")


def snake_case(c: Column) -> Column:
    """UserInfo -> user_info."""
    return F.lower(F.regexp_replace(c, r"(?<!^)([A-Z])", "_$1"))


def title(c: Column) -> Column:
    """Underscores to blanks, words capitalised."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def hex_pairs(c: Column) -> Column:
    """Colon between each two characters."""
    return F.regexp_replace(c, r"(..)(?=.)", "$1:")


def to_text(c: Column, charset: str = "UTF-8") -> Column:
    """Binary to text."""
    return F.decode(c, charset)


def to_bytes(c: Column, charset: str = "UTF-8") -> Column:
    return F.encode(c, charset)


# Fixed value: bare addresses that are not the target of a markdown link.
BARE_URL = r"(?<!\()(http://(\S+))"


def escape_markup(c: Column) -> Column:
    """Escape `<` and mark bare URLs as `<url>`."""
    return F.regexp_replace(F.replace(c, F.lit("<"), F.lit("&lt;")), BARE_URL, "<$1>")


def urls(c: Column) -> Column:
    """All bare URLs of a text."""
    return F.regexp_extract_all(c, F.lit(BARE_URL), F.lit(1))


def replace_and_last(c: Column, pattern: str, replacement: str, groups: int = 1) -> tuple[Column, Column]:
    """The text with all matches replaced, and the groups of the last match (null without one)."""
    last = [F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(g)), F.lit(-1)) for g in range(1, groups + 1)]
    return F.regexp_replace(c, pattern, replacement), F.when(F.regexp_like(c, F.lit(pattern)), F.array(*last))


# The first word gives a statement's kind; the table is the word behind one of these.
BEFORE_TABLE = {"select": "from", "update": "update", "delete": "from", "insert": "into"}


def classify_statements(df: DataFrame, sql: str) -> DataFrame:
    """Add kind and table (null for other statements), reads, and target: `read` when the first word is select, else `write`."""
    c = F.col(sql)
    word = F.lower(F.regexp_extract(c, r"^\s*(\w+)", 1))
    table = F.nullif(F.coalesce(*[F.when(word == kind, F.regexp_extract(c, rf"(?is)\b{before}\s+([^\s,;()]+)", 1))
                                  for kind, before in BEFORE_TABLE.items()]), F.lit(""))
    known = table.isNotNull()
    return df.withColumns({"kind": F.when(known, word), "table": table, "reads": F.when(known, word == "select"),
                           "target": F.when(word == "select", "read").otherwise("write")})
