"""User functions: hooks, bulk actions, error-isolated maps."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from opsframe.operators.joins import chosen


def prepare(df: DataFrame, hook: Callable[[DataFrame], DataFrame] | None = None, **columns: Callable[[Column], Column]) -> DataFrame:
    """Apply a table hook, then column functions, to outgoing rows."""
    out = df.transform(hook) if hook else df
    return out.withColumns({n: f(F.col(n)) for n, f in columns.items()}) if columns else out


class Actions:
    """Named functions on the chosen rows of a table."""

    def __init__(self):
        self._known: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}

    def add(self, name: str, fn: Callable[[DataFrame], DataFrame], description: str = "") -> None:
        self._known[name] = (description or name.replace("_", " "), fn)

    def names(self) -> dict[str, str]:
        return {n: d for n, (d, _) in self._known.items()}

    def run(self, name: str, df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
        """Unknown names and empty id lists are errors."""
        if name not in self._known:
            raise LookupError(f"unknown action {name!r}; known: {sorted(self._known)}")
        if ids.isEmpty():
            raise ValueError("no rows chosen")
        return self._known[name][1](chosen(df, ids, key))


def safe_map(df: DataFrame, fn: Callable[[dict], object], value: T.DataType | str, skip_failures: bool = False,
             keep: list[str] | None = None) -> DataFrame:
    """fn on every row: (kept columns, value, ok, error). A failing row gives null, false and the error text.

    fn sees Python values: whole numbers stay whole, nulls are None. Kept columns pass through untouched. A result
    that doesn't fit `value` is a failure of its row. Rows stream through in Arrow batches, without a shuffle.
    """
    keep = keep if keep is not None else df.columns
    kind = T._parse_datatype_string(value) if isinstance(value, str) else value
    out = T.StructType([df.schema[c] for c in keep] + [T.StructField("value", kind), T.StructField("ok", T.BooleanType()),
                                                       T.StructField("error", T.StringType())])

    arrow = to_arrow_type(kind)

    def apply(batches):
        for batch in batches:
            values, errors = [], []
            for row in batch.to_pylist():
                try:
                    values.append(pa.scalar(fn(row), arrow))
                    errors.append(None)
                except Exception as problem:  # a row's own failure must not end the job
                    values.append(pa.scalar(None, arrow))
                    errors.append(f"{type(problem).__name__}: {problem}")
            made = [pa.array(values, arrow), pa.array([e is None for e in errors], pa.bool_()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "value", "ok", "error"])

    mapped = df.mapInArrow(apply, out)
    return mapped.filter("ok") if skip_failures else mapped
