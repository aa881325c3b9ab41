"""Declarations: tables, indexes, order paths and views, and the registry that holds them.

Nothing here is physical. An index is a recipe: which rows a query over it sees, in which order.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import Refused
from lodestone.functions.coerce import TYPES

KINDS = ("range", "unique", "text", "ann", "agg")
DISTANCES = ("cosine", "l2", "ip")
MOST = 64  # tables, indexes and views each
PATH_COLUMNS, PATH_BYTES = 8, 255
DEPTH, LEAVES = 3, 4
ADVISE_AFTER, ADVISE_LOG = 16, 128


@dataclass(frozen=True)
class Index:
    """One declared access path on a table."""

    name: str
    fields: tuple[str, ...]
    kind: str = "range"
    values: tuple[tuple[str, str], ...] = ()  # stored columns: (name, type)
    weights: tuple[float, ...] = ()
    positions: bool = False
    dim: int = 0
    distance: str = "cosine"
    group: str = ""

    def check(self) -> Index:
        if self.kind not in KINDS:
            raise Refused(f"KIND {self.kind}")
        if not self.fields:
            raise Refused("FIELD is missing")
        if self.kind != "text" and len(self.fields) > 1:
            raise Refused("only a text index takes several fields; declare an ORDERPATH")
        if self.weights and len(self.weights) != len(self.fields):
            raise Refused("WEIGHTS must match FIELD")
        if self.kind == "ann" and (self.dim < 1 or self.dim > 65536 or self.distance not in DISTANCES):
            raise Refused("KIND ann needs DIM 1..65536 and DISTANCE cosine, l2 or ip")
        if self.kind == "agg" and not self.group:
            raise Refused("KIND agg needs GROUPBY")
        if self.kind != "agg" and self.group:
            raise Refused("GROUPBY needs KIND agg")
        if self.positions and self.kind != "text":
            raise Refused("WITH POSITIONS needs KIND text")
        return self


@dataclass(frozen=True)
class OrderPath:
    """A composite order: columns and which of them descend."""

    name: str
    columns: tuple[str, ...]
    desc: tuple[bool, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "desc", self.desc or (False,) * len(self.columns))


@dataclass(frozen=True)
class Window:
    """Age window of a table: rows older than `span` behind the newest bucket are cold. Queries don't change."""

    column: str
    span: int
    bucket: int


@dataclass(frozen=True)
class Table:
    """Typed columns over the rows of one key prefix; key = prefix + primary key."""

    name: str
    prefix: str
    pk: str
    columns: tuple[tuple[str, str], ...]
    indexes: tuple[Index, ...] = ()
    paths: tuple[OrderPath, ...] = ()
    window: Window | None = None
    autodeclare: int = 0

    def type_of(self, column: str) -> str:
        for name, kind in self.columns:
            if name == column:
                return kind
        raise Refused(f"column {column} is not declared in {self.name}")

    def check(self) -> Table:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.name):
            raise Refused(f"table name {self.name!r}")
        names = [c for c, _ in self.columns]
        if twice := [c for c, n in Counter(names).items() if n > 1]:
            raise Refused(f"column {twice[0]} is declared twice")
        for c, kind in self.columns:
            if kind not in TYPES:
                raise Refused(f"TYPE {kind} of column {c}")
        self.type_of(self.pk)
        used = [i.name for i in self.indexes] + [p.name for p in self.paths]
        if twice := [c for c, n in Counter(used).items() if n > 1]:
            raise Refused(f"path {twice[0]} is declared twice")
        for i in self.indexes:
            i.check()
            for c in (*i.fields, *(v for v, _ in i.values), *([i.group] if i.group else [])):
                self.type_of(c)
        for p in self.paths:
            if not 1 <= len(p.columns) <= PATH_COLUMNS or len(p.desc) != len(p.columns):
                raise Refused(f"ORDERPATH {p.name} takes 1 to {PATH_COLUMNS} columns")
            for c in p.columns:
                self.type_of(c)
        if self.window:
            if self.type_of(self.window.column) != "i64":
                raise Refused("WINDOW needs an i64 column")
            if self.window.bucket < 1 or self.window.span < self.window.bucket:
                raise Refused("WINDOW needs SPAN >= BUCKET >= 1")
        if not 0 <= self.autodeclare <= MOST:
            raise Refused(f"AUTODECLARE is 0..{MOST}")
        return self

    def index(self, name: str) -> Index | OrderPath:
        for p in (*self.indexes, *self.paths):
            if p.name == name or f"{self.name}.{p.name}" == name:
                return p
        raise Refused(f"no index {name} on {self.name}; declare it")


@dataclass(frozen=True)
class Leaf:
    """A condition of a view: one index, a range or a value."""

    index: str
    low: object = None
    high: object = None


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR, DIFF
    left: Leaf | Node
    right: Leaf | Node


@dataclass(frozen=True)
class View:
    """Members of a tree of conditions in the order of an index, as a whole or the first `topk`."""

    name: str
    table: str
    tree: Leaf | Node
    order: str
    desc: bool = False
    materialized: bool = False
    topk: int = 0
    via: str = ""

    def check(self) -> View:
        def walk(t, depth: int) -> int:
            if depth > DEPTH:
                raise Refused(f"a view tree is at most {DEPTH} deep")
            if isinstance(t, Leaf):
                return 1
            if t.op not in ("AND", "OR", "DIFF"):
                raise Refused(f"view operator {t.op}")
            return walk(t.left, depth + 1) + walk(t.right, depth + 1)

        if walk(self.tree, 1) > LEAVES:
            raise Refused(f"a view tree has at most {LEAVES} leaves")
        if self.topk and not self.materialized:
            raise Refused("TOPK needs MODE materialized")
        return self


@dataclass
class Registry:
    """What is declared, and the frames that the tables read."""

    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    frames: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    refused: deque = field(default_factory=lambda: deque(maxlen=ADVISE_LOG))

    def declare(self, table: Table, frame: Callable[[], DataFrame] | None = None) -> Table:
        """Declare a table that isn't there yet, all or nothing."""
        if table.name in self.tables:
            raise Refused(f"table {table.name} exists; ENSURE or REPLACE it")
        if len(self.tables) >= MOST:
            raise Refused(f"at most {MOST} tables")
        if sum(len(t.indexes) + len(t.paths) for t in self.tables.values()) + len(table.indexes) + len(table.paths) > MOST:
            raise Refused(f"at most {MOST} indexes")
        if clash := next((t.name for t in self.tables.values() if t.prefix.startswith(table.prefix) or table.prefix.startswith(t.prefix)), None):
            raise Refused(f"prefix {table.prefix} overlaps that of {clash}")
        self.tables[table.name] = table.check()
        if frame:
            self.frames[table.name] = frame
        return table

    def ensure(self, table: Table, frame: Callable[[], DataFrame] | None = None) -> list[str]:
        """Declare, or add what an existing table lacks. Conflicting declarations are refused. Returns what changed."""
        old = self.tables.get(table.name)
        if old is None:
            self.declare(table, frame)
            return [f"table {table.name}"]
        if (old.prefix, old.pk) != (table.prefix, table.pk):
            raise Refused(f"table {table.name} has another PREFIX or PK; REPLACE it")
        known = dict(old.columns)
        for c, kind in table.columns:
            if known.get(c, kind) != kind:
                raise Refused(f"column {c} is {known[c]}; REPLACE the table")
        paths = {p.name: p for p in (*old.indexes, *old.paths)}
        for p in (*table.indexes, *table.paths):
            if paths.get(p.name, p) != p:
                raise Refused(f"index {p.name} is declared otherwise; REPLACE the table")
        new_columns = [c for c in table.columns if c[0] not in known]
        new_indexes, new_paths = [i for i in table.indexes if i.name not in paths], [p for p in table.paths if p.name not in paths]
        merged = replace(old, columns=(*old.columns, *new_columns), indexes=(*old.indexes, *new_indexes), paths=(*old.paths, *new_paths), window=table.window or old.window)
        self.tables[table.name] = merged.check()
        return [f"column {c}" for c, _ in new_columns] + [f"index {i.name}" for i in new_indexes] + [f"orderpath {p.name}" for p in new_paths]

    def replace(self, table: Table, frame: Callable[[], DataFrame] | None = None) -> Table:
        """Validate, then swap the declaration as a whole."""
        table.check()
        old, frames = self.tables.pop(table.name, None), self.frames.get(table.name)
        try:
            return self.declare(table, frame or frames)
        except Refused:
            if old:
                self.tables[table.name] = old
            raise

    def drop(self, name: str) -> None:
        if name not in self.tables:
            raise Refused(f"no table {name}")
        if used := next((v.name for v in self.views.values() if v.table == name), None):
            raise Refused(f"view {used} reads {name}")
        del self.tables[name]
        self.frames.pop(name, None)

    def create_index(self, table: str, index: Index) -> None:
        t = self.table(table)
        if index.name in [p.name for p in (*t.indexes, *t.paths)]:
            raise Refused(f"index {index.name} exists")
        self.tables[table] = replace(t, indexes=(*t.indexes, index)).check()

    def drop_index(self, table: str, name: str) -> None:
        t = self.table(table)
        t.index(name)
        self.tables[table] = replace(t, indexes=tuple(i for i in t.indexes if i.name != name), paths=tuple(p for p in t.paths if p.name != name))

    def create_view(self, view: View) -> View:
        if view.name in self.views or len(self.views) >= MOST:
            raise Refused(f"view {view.name} exists" if view.name in self.views else f"at most {MOST} views")
        self.table(view.table).index(view.order)
        self.views[view.name] = view.check()
        return view

    def drop_view(self, name: str) -> None:
        if self.views.pop(name, None) is None:
            raise Refused(f"no view {name}")

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise Refused(f"no table {name}; declare it")
        return self.tables[name]

    def advise(self, table: str, column: str) -> str | None:
        """Note that a query on an undeclared column was refused; from the sixteenth on, say which index would serve it."""
        self.refused.append((table, column))
        n = self.refused.count((table, column))
        if n < ADVISE_AFTER:
            return None
        t = self.table(table)
        budget = sum(i.name.startswith("auto_") for i in t.indexes)
        if budget < t.autodeclare:
            self.create_index(table, Index(f"auto_{column}", (column,)))
        return f"INDEX {column} range"

    def advice(self, spark: SparkSession) -> DataFrame:
        """Shapes refused ADVISE_AFTER times or more, with the declaration to add."""
        rows = [(t, c, n, f"INDEX {c} range") for (t, c), n in sorted(Counter(self.refused).items()) if n >= ADVISE_AFTER]
        return spark.createDataFrame(rows, "table string, column string, refused long, declaration string")

    def list_tables(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.prefix, t.pk, len(t.columns), len(t.indexes), len(t.paths), t.window.column if t.window else None) for t in self.tables.values()]
        return spark.createDataFrame(rows, "name string, prefix string, pk string, columns long, indexes long, orderpaths long, window string")

    def list_indexes(self, spark: SparkSession) -> DataFrame:
        rows = [(f"{t.name}.{i.name}", i.kind, ",".join(i.fields), ",".join(v for v, _ in i.values)) for t in self.tables.values() for i in t.indexes]
        rows += [(f"{t.name}.{p.name}", "orderpath", ",".join(c + " DESC" * d for c, d in zip(p.columns, p.desc, strict=True)), "") for t in self.tables.values() for p in t.paths]
        return spark.createDataFrame(rows, "name string, kind string, fields string, stored string")

    def list_views(self, spark: SparkSession) -> DataFrame:
        rows = [(v.name, v.table, v.order, v.desc, v.materialized, v.topk, v.via) for v in self.views.values()]
        return spark.createDataFrame(rows, "name string, table string, order_by string, descending boolean, materialized boolean, topk long, via string")
