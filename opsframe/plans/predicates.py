"""Predicates from values, maps, text with variables, and request parameters."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsframe.plans.model import SEP, Model, Node, all_of, any_of, field_tree, join_path_columns

# --- where, variables, raw SQL -------------------------------------------------------------------

_VARIABLE = re.compile(r"\$(?:(?P<dollar>\$)|\{(?P<braced>[^}]*)\}|(?P<plain>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[[^\]]+\])*))")
_PATH = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[\s*(?:-?\d+|'[^']*'|\"[^\"]*\")\s*\])*")
_STEP = re.compile(r"\.?([A-Za-z_]\w*)|\[\s*(-?\d+|'[^']*'|\"[^\"]*\")\s*\]")


def lookup(expression: str, values: dict):
    """Value of `name`, `a.b`, `a[0]` or `a['k']`; nothing else is evaluated."""
    text, value = expression.strip(), values
    if not _PATH.fullmatch(text):
        raise ValueError(f"cannot bind {expression!r}: use names, dots and indexes")
    for name, index in _STEP.findall(text):
        if index:
            value = value[int(index)] if index.lstrip("-").isdigit() else value[index[1:-1]]
        else:
            value = value[name] if isinstance(value, dict) else getattr(value, name)
    return value


def bind(text: str, values: dict | None = None) -> tuple[str, dict]:
    """Turn `$name` text into Spark SQL with named parameters. A list becomes an IN list; `$$` is `$`."""
    args: dict = {}

    def parameter(value) -> str:
        name = f"p{len(args)}"
        args[name] = value
        return f":{name}"

    def replace(match: re.Match) -> str:
        if match.group("dollar"):
            return "$"
        value = lookup(match.group("braced") or match.group("plain"), values or {})
        if isinstance(value, (list, tuple, set)):
            items = list(value)
            return "(" + ", ".join(parameter(v) for v in items) + ")" if items else "(NULL)"
        return parameter(value)

    return _VARIABLE.sub(replace, text), args


def run_sql(spark: SparkSession, text: str, values: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Raw SQL over `{table}` frames with `$name` variables."""
    bound, args = bind(text, values)
    return spark.sql(bound, args=args, **tables)


def equalities(values: dict, connector: str = "and") -> Column:
    """Equality per entry, joined by `and` or `or`; a list value means any of its items, None means IS NULL."""
    def one(name, value):
        if isinstance(value, (list, tuple, set)):
            return value_in(F.col(name), value)
        return F.col(name).isNull() if value is None else F.col(name) == F.lit(value)

    parts = [one(n, v) for n, v in values.items()]
    if connector not in ("and", "or"):
        raise ValueError("connector must be 'and' or 'or'")
    return all_of(parts) if connector == "and" or not parts else any_of(parts)


def value_in(column: Column, values) -> Column:
    """Any of the values; an empty list matches nothing."""
    items = list(values) if isinstance(values, (list, tuple, set)) else [values]
    return column.isin(items) if items else F.lit(False)


def where(df: DataFrame, condition=None, values: dict | None = None, key: str = "id") -> DataFrame:
    """An integer means key = n, a dict means equalities, text may hold `$name` variables."""
    if isinstance(condition, Column):
        return df.filter(condition)
    if condition is None or condition == {}:
        return df
    if isinstance(condition, int):
        return df.filter(F.col(key) == condition)
    if isinstance(condition, dict):
        return df.filter(equalities(condition))
    text = condition.replace("{", "{{").replace("}", "}}")  # braces of the condition aren't names of frames
    return run_sql(df.sparkSession, f"SELECT * FROM {{_rows}} WHERE {text}", values, _rows=df)


def select(df: DataFrame, what: str | list = "*", condition=None, values: dict | None = None, group=None,
           order: list | str | None = None, limit: int | None = None, offset: int | None = None, key: str = "id") -> DataFrame:
    """One-call select: where, group, columns, order, offset, limit.

    Columns, group and order may be SQL text. An order given as a list has the form of a request, see `order_columns`.
    """
    items = what if isinstance(what, list) else top_level(what)
    out = where(df, condition, values, key)
    if group:
        names = group if isinstance(group, list) else top_level(group)
        aggregates = [F.expr(i) for i in items if i not in names]
        out = out.groupBy(*names).agg(*aggregates)
    if order:
        out = out.orderBy(*(order_terms(out, order) if isinstance(order, str) else order_columns(out, order)))
    if not group:
        out = out.selectExpr(*items)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit is not None else out


def top_level(text: str) -> list[str]:
    """The parts between commas that stand outside brackets and quotes."""
    parts, depth, quote = [""], 0, None
    for c in text:
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        if c == "," and not depth and not quote:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def order_terms(df: DataFrame, text: str) -> list[Column]:
    """ORDER BY text as columns: expressions, each with ASC or DESC; `-name` of a column is descending.

    Nulls come first ascending and last descending.
    """
    found = []
    for term in top_level(text):
        if term.startswith("-") and term[1:] in df.columns:
            found.append(F.col(term[1:]).desc_nulls_last())
            continue
        said = re.fullmatch(r"(?is)(.*?)\s+(asc|desc)", term)
        column = F.expr(said[1] if said else term)
        found.append(column.desc_nulls_last() if said and said[2].lower() == "desc" else column.asc_nulls_first())
    return found


def order_columns(df: DataFrame, order) -> list[Column]:
    """`col`, `-col` or `col desc`; names that are not columns are ignored. Nulls first ascending, last descending."""
    found = []
    for item in [order] if isinstance(order, str) else order:
        name, _, direction = item.strip().partition(" ")
        down = name.startswith("-") or direction.strip().lower() == "desc"
        name = name.lstrip("-")
        if name in df.columns:
            found.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first())
    return found


# --- typed filters -------------------------------------------------------------------------------

# The twelve filter labels and the catalogue of filters per kind of column.
EQUAL, NOT_EQUAL = "equal to", "not equal to"
LESS, GREATER = "less than", "greater than"
LESS_EQUAL, GREATER_EQUAL = "less than or equal to", "greater than or equal to"
STARTS, CONTAINS = "starts with", "contains"
WITHIN, OLDER, YEAR, MONTH = "within X days ago", "older than X days ago", "year equals", "month equals"
CATALOGUE = {
    "string": [EQUAL, NOT_EQUAL, STARTS, CONTAINS],
    "numeric": [EQUAL, NOT_EQUAL, LESS, GREATER, LESS_EQUAL, GREATER_EQUAL],
    "datetime_date": [EQUAL, NOT_EQUAL, LESS, GREATER, LESS_EQUAL, GREATER_EQUAL, WITHIN, OLDER, YEAR, MONTH],
    "foreign_key": [EQUAL, NOT_EQUAL],
    "boolean": [EQUAL, NOT_EQUAL],
}


def typed_filter(column: Column, operation: str, value, today: dt.date | None = None) -> Column:
    """One of the twelve filters. `starts with` ignores case and wildcards; `contains` keeps % and _ as wildcards."""
    simple = {EQUAL: column.__eq__, NOT_EQUAL: column.__ne__, LESS: column.__lt__, LESS_EQUAL: column.__le__,
              GREATER: column.__gt__, GREATER_EQUAL: column.__ge__}
    if operation in simple:
        return simple[operation](F.lit(value))
    if operation == STARTS:
        return F.lower(F.substring(column, 1, len(value))) == value.lower()
    if operation == CONTAINS:
        return column.ilike(f"%{value}%")
    if operation == YEAR:  # a range reaches the scan; years beyond the calendar's have no rows to skip
        year = int(value)
        return (column >= F.lit(dt.date(year, 1, 1))) & (column < F.lit(dt.date(year + 1, 1, 1))) if 0 < year < 9999 else F.year(column) == year
    if operation == MONTH:
        return F.month(column) == int(value)
    if operation in (WITHIN, OLDER):
        edge = F.lit((today or dt.date.today()) - dt.timedelta(days=int(value)))
        return column >= edge if operation == WITHIN else column < edge
    raise ValueError(f"unknown filter {operation!r}")


def kind_of(model: Model, column: str) -> str:
    """The catalogue entry of a column; unknown types count as numeric."""
    if any(link.column == column for link in model.links.values()):
        return "foreign_key"
    kind = model.frame.schema[column].dataType
    for types, name in (((T.StringType, T.VarcharType, T.CharType), "string"), ((T.BooleanType,), "boolean"),
                        ((T.DateType, T.TimestampType, T.TimestampNTZType), "datetime_date")):
        if isinstance(kind, types):
            return name
    return "numeric"


def filter_catalogue(model: Model, tree: Node | None = None) -> DataFrame:
    """Every exposed column, the filters that apply to it and how many rows they can act on.

    (path, kind, position, operation, filled); the counts come from one pass over the joined rows.
    """
    tree = tree or field_tree(model)

    def walk(node: Node, prefix: str):
        for name in node.fields:
            kind = kind_of(node.model, name)
            yield from ((prefix + name, kind, i, label) for i, label in enumerate(CATALOGUE[kind]))
        for rel, child in node.children.items():
            yield from walk(child, f"{prefix}{rel}{SEP}")

    paths = tree.paths()
    counted = join_path_columns(model, paths, "left").agg(*[F.count(p).alias(p) for p in paths])
    filled = counted.select(F.explode(F.create_map(*[x for p in paths for x in (F.lit(p), F.col(p))])).alias("path", "filled"))
    spark = model.frame.sparkSession
    filters = spark.createDataFrame(list(walk(tree, "")), "path string, kind string, position int, operation string")
    return filled.join(F.broadcast(filters), "path")


def filter_request(model: Model, request: dict[str, list[tuple[int, object]]], tree: Node | None = None,
                   today: dt.date | None = None) -> DataFrame:
    """Rows matching a form request {path: [(filter position, value), ...]}.

    Values of one field are alternatives, fields must all match, related fields join along their path.
    """
    tree = tree or field_tree(model)
    exposed = [p for p in tree.paths() if p in request]
    joined = join_path_columns(model, exposed)
    conditions = []
    for path in exposed:
        owner, _, name = path.rpartition(SEP)
        holder = model
        for rel in owner.split(SEP) if owner else []:
            holder = holder.links[rel].model
        labels = CATALOGUE[kind_of(holder, name)]
        conditions.append(any_of([typed_filter(F.col(path), labels[int(i)], v, today) for i, v in request[path]]))
    return joined.filter(all_of(conditions)).select(*model.columns)


# --- lookup filters ------------------------------------------------------------------------------

LOOKUPS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "in": lambda c, v: value_in(c, v),
    "is": lambda c, v: c.isNull() if v in (None, "", "None", "null") else c.eqNullSafe(v),
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "regexp": lambda c, v: c.rlike(v),
}


def parse_lookups(request: dict[str, list[str]]) -> dict[str, list[tuple[str, list[str], bool]]]:
    """`path__op=value` pairs as {path: [(op, values, negated)]}; a leading `-` negates, no known op means eq."""
    parsed: dict = {}
    for key, values in request.items():
        name = key.lstrip("-") if key.startswith("-") else key
        path, _, op = name.rpartition(SEP)
        if not path or op not in LOOKUPS:
            path, op = name, "eq"
        values = [values] if isinstance(values, str) else list(values)
        if op == "in":
            values = [v.strip() for v in values[0].split(",")]
        parsed.setdefault(path, []).append((op, values, key.startswith("-")))
    return parsed


def lookup_condition(path: str, op: str, values: list, negated: bool, kind: T.DataType) -> Column:
    def typed(v):
        return v if op in ("is", "like", "ilike", "regexp") else F.lit(v).cast(kind)

    def signed(c: Column) -> Column:
        return ~c if negated else c

    if op == "in":
        return signed(any_of([F.col(path) == typed(v) for v in values]))
    return reduce(lambda a, b: a | b, [signed(LOOKUPS[op](F.col(path), typed(v))) for v in values])


def lookup_filter(model: Model, request: dict, tree: Node | None = None, keep: list[str] = ()) -> DataFrame:
    """Rows matching lookup parameters. Keys outside the field tree are ignored.

    `keep` names further related columns (`a__b__col`) to carry along in the same joins.
    """
    exposed = set((tree or field_tree(model)).paths())
    parsed = {p: tests for p, tests in parse_lookups(request).items() if p in exposed}
    joined = join_path_columns(model, [*parsed, *keep])
    conditions = [lookup_condition(p, op, values, negated, joined.schema[p].dataType)
                  for p, tests in parsed.items() for op, values, negated in tests]
    related = [c for c in keep if SEP in c]
    return joined.filter(all_of(conditions)).select(*model.columns, *related)


# --- rows and values -----------------------------------------------------------------------------

def first_row(df: DataFrame, order: list) -> DataFrame:
    return df.orderBy(*order).limit(1)


def first_value(df: DataFrame, column: str, order: list) -> DataFrame:
    return first_row(df, order).select(column)


def only_row(df: DataFrame):
    """The single row, None when there is none, an error when there are more."""
    rows = df.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("more than one row matches")
    return rows[0] if rows else None


def search(df: DataFrame, text: str, key: str, others: list[str]) -> DataFrame:
    """Exact match on the key, ignoring case; only if there is none, substring match on key and others.

    The one-row flag is computed by a separate aggregate, so the rows themselves are not shuffled.
    """
    if not text:
        return df
    needle = text.lower()
    exact = F.lower(F.col(key)) == needle
    partial = any_of([F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(needle)), F.lit(False))
                      for c in [key, *others]])
    found = df.agg(F.coalesce(F.bool_or(exact), F.lit(False)).alias("_any"))
    return df.filter(exact | partial).join(F.broadcast(found), F.when(F.col("_any"), exact).otherwise(partial)).drop("_any")


def host_pattern(column: Column, patterns: str) -> Column:
    """`:`-separated hosts: exact names, `*`/`?` wildcards, or `~regex`."""
    def one(p: str) -> Column:
        if p.startswith("~"):
            return column.rlike(p[1:])
        if any(ch in p for ch in "*?"):
            body = "".join(".*" if ch == "*" else "." if ch == "?" else re.escape(ch) for ch in p)
            return column.rlike(f"^{body}$")
        return column == p

    return any_of([one(p.strip()) for p in patterns.split(":") if p.strip()])


def owned(column: str, user) -> Column:
    """Only the caller's rows may be changed."""
    return F.col(column) == F.lit(user)
