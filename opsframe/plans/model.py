"""Typed tables with foreign keys, and the tree of columns a request may touch."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "__"


@dataclass
class Model:
    """A table: its frame, key column and foreign keys {column: (related model, relation name)}."""

    name: str
    frame: DataFrame
    key: str
    links: dict[str, Link] = field(default_factory=dict)

    def link(self, relation: str, column: str, model: Model, nullable: bool = False) -> Model:
        self.links[relation] = Link(relation, column, model, nullable)
        return self

    @property
    def columns(self) -> list[str]:
        return self.frame.columns


@dataclass
class Link:
    relation: str
    column: str
    model: Model
    nullable: bool = False


@dataclass
class Node:
    """Exposed columns of one model and of the models below it."""

    model: Model
    fields: list[str]
    children: dict[str, Node]

    def paths(self, prefix: str = "") -> list[str]:
        own = [prefix + f for f in self.fields]
        return own + [p for rel, child in self.children.items() for p in child.paths(f"{prefix}{rel}{SEP}")]


def field_tree(model: Model, fields=None, exclude=None, force_recursion: bool = False, _seen=(), depth: int = 2) -> Node:
    """Exposed columns. Names take `relation__column` nesting; each link is visited once, if forced up to `depth` times."""
    def split(names):
        own, below = [], {}
        for n in names or []:
            head, _, rest = n.partition(SEP)
            below.setdefault(head, []).append(rest) if rest else own.append(n)
        return own, below

    named, below = split(fields)
    hidden, hidden_below = split(exclude)
    own = [n for n in named if n not in model.links]
    shown = [c for c in (own or model.columns) if c not in hidden]
    children = {}
    for rel, link in model.links.items():
        mark = (model.name, rel)
        wanted = (not fields) or rel in below or rel in named
        if not wanted or rel in hidden or (mark in _seen and not force_recursion):
            continue
        if force_recursion and list(_seen).count(mark) >= depth:
            continue
        children[rel] = field_tree(link.model, below.get(rel), hidden_below.get(rel), force_recursion, (*_seen, mark), depth)
    return Node(model, shown, children)


def models_on_path(model: Model, path: str) -> list[Model]:
    """The related models along `a__b`; an unknown relation is an error."""
    found = []
    for rel in path.split(SEP):
        if rel not in model.links:
            raise AttributeError(f"{model.name} has no relation {rel!r}")
        model = model.links[rel].model
        found.append(model)
    return found


def join_path_columns(model: Model, lookups: list[str], how: str = "inner") -> DataFrame:
    """The model's rows with one column per lookup `a__b__col`; every path is joined once, under its own alias.

    Only the needed columns of a related table enter its join. Related tables join on their key;
    AQE broadcasts those measured small and splits skewed partitions of the others.
    """
    needed: dict[str, list[str]] = {}
    for lookup in lookups:
        path, _, column = lookup.rpartition(SEP)
        if path:
            models_on_path(model, path)
            needed.setdefault(path, []).append(column)
    for path in list(needed):
        while SEP in path:
            path = path.rpartition(SEP)[0]
            needed.setdefault(path, [])
    frame = model.frame
    for path in sorted(needed, key=lambda p: p.count(SEP)):
        parent, _, rel = path.rpartition(SEP)
        holder = models_on_path(model, parent)[-1] if parent else model
        link = holder.links[rel]
        target = link.model
        below = [p for p in needed if p.startswith(path + SEP) and p.count(SEP) == path.count(SEP) + 1]
        keep = {*needed[path], target.key, *[target.links[p.rpartition(SEP)[2]].column for p in below]}
        side = target.frame.select([F.col(c).alias(f"{path}{SEP}{c}") for c in target.columns if c in keep])
        left = f"{parent}{SEP}{link.column}" if parent else link.column
        frame = frame.join(side, F.col(left) == F.col(f"{path}{SEP}{target.key}"), how)
    return frame


def select_lookups(model: Model, lookups: list[str], how: str = "inner") -> DataFrame:
    return join_path_columns(model, lookups, how).select(*lookups)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    """False for an empty list."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)
